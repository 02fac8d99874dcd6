"""What a test may ask of an executed or planned query."""


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return executed(df).count("Exchange ")


def scans(df) -> int:
    return executed(df).count("FileScan ")


def shuffled_rows(df) -> int:
    """Run the query; how many rows did its exchanges write?"""
    df.collect()
    written, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(node.plan())
        else:
            if name == "ShuffleExchangeExec":
                written += node.metrics().apply("shuffleRecordsWritten").value()
            children = node.children()
            nodes += [children.apply(i) for i in range(children.size())]
    return written


def scan_metrics(df) -> dict[str, int]:
    """Run the query; what its file scans read, added up: numFiles, numOutputRows and so on."""
    df.collect()
    found, nodes = {}, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(node.plan())
        elif name == "FileSourceScanExec":
            metrics = node.metrics()
            for key in ("numFiles", "numOutputRows", "numPartitions"):
                if metrics.contains(key):
                    found[key] = found.get(key, 0) + metrics.apply(key).value()
        else:
            children = node.children()
            nodes += [children.apply(i) for i in range(children.size())]
    return found


def rows_of_joins(df) -> list[int]:
    """Run the query; how many rows came out of each of its joins?"""
    df.collect()
    found, nodes = [], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(node.plan())
        else:
            if "Join" in name:
                found.append(node.metrics().apply("numOutputRows").value())
            children = node.children()
            nodes += [children.apply(i) for i in range(children.size())]
    return found
