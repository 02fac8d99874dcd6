"""Quality rules judged per host, with DataFrame functions only.

Every document is held against rules of its own. Per host the failures are
counted, the host's failure rate is pulled towards that of all hosts by a beta
prior fitted to the hosts' rates, and a host whose rate is still too high loses
all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.llm.common import carried, staged

BLANK = r"\x20\x09-\x0D"
WORD = f"[^{BLANK}]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
MOST_HOST_FAILURES = 0.5
# Texts above this size are measured by rows of words instead of arrays, which a JVM must hold whole.
LONG_BYTES = 4 << 20
PIECE_CHARACTERS = 1 << 16


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text.

    A NULL text counts as empty. Repeated windows are found by sorting 64-bit
    hashes of the windows; the sort runs only for texts in which any repeats.
    """
    given = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(given, "\n"), lambda line: line.rlike(f"[^{BLANK}]"))
    out = docs.withColumns({"_words": F.regexp_extract_all(given, F.lit(f"({WORD})")), "_lines": lines})
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(given, F.lit(SYMBOL)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_words": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    )
    starts = F.when(F.size("_words") >= WINDOW, F.sequence(F.lit(0), F.size("_words") - WINDOW))
    windows = F.transform(starts, lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(WINDOW))))
    out = out.withColumn("_windows", F.coalesce(windows, F.array().cast("array<long>")))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    out = out.withColumn("_sorted", F.when(repeats, F.sort_array(placed)))
    twice = F.filter(
        "_sorted",
        lambda w, i: F.coalesce(w["h"] == F.get("_sorted", i - 1)["h"], F.lit(False))
        | F.coalesce(w["h"] == F.get("_sorted", i + 1)["h"], F.lit(False)),
    )
    out = out.withColumn("_at", F.sort_array(F.transform(twice, lambda w: w["i"])))
    # Each repeated window covers its words up to the next one's first.
    covered = F.transform("_at", lambda p, i: F.least(F.coalesce(F.get("_at", i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop(
        "_words", "_lines", "_windows", "_sorted", "_at"
    )


def long_measures(docs: DataFrame, text: str) -> DataFrame:
    """(id, n_words, ...): ``measures`` of long texts, from rows (id, text), without a whole text's words in one place.

    A text is cut after words into pieces, and each word becomes a row.
    Windows are then made, counted and placed by sorted and grouped rows, which spill to disk.
    """
    pieces = docs.select("id", F.posexplode(F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{PIECE_CHARACTERS}}}[^{BLANK}]*)"))).alias("piece", "part"))
    words = F.regexp_extract_all("part", F.lit(f"({WORD})"))
    counts = pieces.select("id", words.alias("words"), F.regexp_count("part", F.lit(SYMBOL)).alias("symbols"))
    counts = counts.groupBy("id").agg(
        F.sum(F.size("words")).alias("n_words"), F.sum(F.length(F.array_join("words", ""))).alias("word_chars"), F.sum("symbols").alias("n_symbols")
    )
    lines = docs.select("id", F.explode(F.split(text, "\n")).alias("line")).where(F.col("line").rlike(f"[^{BLANK}]"))
    lines = lines.groupBy("id", F.sha2("line", 256).alias("line")).agg((F.count("*") - 1).alias("copies"))
    lines = lines.groupBy("id").agg(F.sum("copies").alias("n_dup_lines"))

    placed = pieces.select("id", "piece", F.posexplode(F.transform(words, lambda w: F.xxhash64(w))).alias("at", "word"))
    order = Window.partitionBy("id").orderBy("piece", "at")
    following = [F.lead("word", k).over(order).alias(f"word{k}") for k in range(1, WINDOW)]
    placed = placed.select("id", F.row_number().over(order).alias("place"), "word", *following).where(f"word{WINDOW - 1} is not null")
    windows = placed.select("id", "place", F.xxhash64("word", *(f"word{k}" for k in range(1, WINDOW))).alias("window"))
    windows = staged(windows, "windows")
    twice = windows.groupBy("id", "window").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = windows.join(staged(twice, "repeated"), ["id", "window"], "left_semi")
    # Each repeated window covers its words up to the next one's first.
    until = F.lead("place").over(Window.partitionBy("id").orderBy("place")) - F.col("place")
    covered = repeated.select("id", F.least(F.coalesce(until, F.lit(WINDOW)), F.lit(WINDOW)).alias("covered"))
    covered = covered.groupBy("id").agg(F.sum("covered").alias("n_repeat_words"))
    both = counts.join(lines, "id", "left").join(covered, "id", "left")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return both.select("id", *(F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in names))


def base_failed() -> Column:
    """Too few words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def host_rates(verdicts: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, host_rate) from rows (host, failed).

    ``host_rate`` is the mean of the beta posterior. The prior has the mean of
    all documents; its weight follows from how far the hosts' rates lie apart
    beyond what chance gives. Hosts no further apart than by chance share one rate.
    """
    hosts = verdicts.groupBy("host").agg(F.count("*").alias("n_docs"), F.count_if("failed").alias("n_failed"))
    hosts = staged(hosts, "hosts")
    n, k = F.col("n_docs"), F.col("n_failed")
    total, failed, of_squares, count = hosts.agg(F.sum(n), F.sum(k), F.sum(k * k / n), F.count("*")).first()
    if not total:
        return hosts.withColumn("host_rate", F.lit(0.0))
    mean = failed / total
    spread = of_squares / total - mean**2 - mean * (1 - mean) * count / total
    if spread <= 0:
        return hosts.withColumn("host_rate", F.lit(mean).cast("double"))
    weight = max(0.0, mean * (1 - mean) / spread - 1)
    return hosts.withColumn("host_rate", (k + mean * weight) / (n + weight))


def judge(docs: DataFrame, host: Column, text: str = "text", most_failures: float = MOST_HOST_FAILURES) -> DataFrame:
    """``docs`` without the text, with the measures, base_failed, host_rate and kept.

    A document is kept if it passes its own rules and its host's rate is not
    above ``most_failures``. Texts of more than ``LONG_BYTES`` are measured
    by ``long_measures``, with the same results. A NULL host is a host of its own. Repeated rows
    count as often as they come; columns of the names added are replaced.
    """
    added = ("host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "kept")
    columns = [c for c in docs.columns if c != text and c not in added]
    short = F.coalesce(F.octet_length(F.col(text)) <= LONG_BYTES, F.lit(True))
    given = docs.select(
        carried(columns).alias("own"), host.alias("host"), F.when(short, F.col(text)).alias("text"), F.when(~short, F.col(text)).alias("long_text")
    )
    measured = staged(measures(given, "text").drop("text"), "measured")
    long, measured = measured.where("long_text is not null"), measured.where("long_text is null").drop("long_text")
    if not long.isEmpty():
        # The few long texts once more, with a number each that stays theirs.
        numbered = staged(long.select("own", "host", "long_text", F.monotonically_increasing_id().alias("id")), "long")
        of_long = numbered.drop("long_text").join(long_measures(numbered, "long_text"), "id").drop("id")
        measured = measured.unionByName(staged(of_long.select(measured.columns), "long_measured"))
    measured = measured.withColumn("base_failed", base_failed())
    rates = host_rates(measured.select("host", F.col("base_failed").alias("failed")))
    rates = rates.select(F.col("host").alias("of_host"), "host_rate")
    judged = measured.join(rates, F.col("host").eqNullSafe(F.col("of_host")), "left")
    kept = ~F.col("base_failed") & (F.col("host_rate") <= most_failures)
    return judged.withColumn("kept", kept).select(*(F.col("own")[c].alias(c) for c in columns), *added)
