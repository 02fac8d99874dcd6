"""Articles out of page layouts that were never trained on, and without any markup to learn from."""

import re

import numpy as np
import pytest

from skeletons import AROUND, SKELETONS
from test_llm import table
from tidegauge.llm import html_blocks


@pytest.fixture(scope="module")
def pages(spark):
    found = sorted(r.html for r in table(spark, "pages", "sf0.01").collect())
    return [found[i] for i in np.random.default_rng(2).permutation(len(found))]


def put_into(skeleton, pages):
    """Per page of the skeleton its blocks, and which of them are main text."""
    for page in pages:
        article = re.search("<article>(.*)</article>", page, re.S).group(1)
        own = {b.text: html_blocks.markup_label(b.path) for b in html_blocks.leaf_blocks(f"<article>{article}</article>")}
        blocks = html_blocks.leaf_blocks(skeleton.replace("{main}", article))
        yield blocks, np.array([not b.text.startswith(AROUND) and own.get(b.text, False) for b in blocks])


def shares(weights, skeleton, pages):
    """The share of main blocks kept, and of others kept."""
    blocks, wanted = zip(*put_into(skeleton, pages))
    found = html_blocks.probabilities([html_blocks.encode_page(b) for b in blocks], weights)
    kept, wanted = np.concatenate(found) >= 0.5, np.concatenate(wanted)
    return kept[wanted].mean(), kept[~wanted].mean()


@pytest.fixture(scope="module")
def trained(pages):
    return html_blocks.train(sorted(pages[:150]))


@pytest.mark.parametrize("name", SKELETONS)
def test_unseen_skeletons(trained, pages, name):
    kept, wrong = shares(trained, SKELETONS[name], pages[170:])
    assert kept >= 0.95 and wrong <= 0.02


def test_given_pages(trained, pages):
    for page in pages:
        blocks = html_blocks.leaf_blocks(page)
        (p,) = html_blocks.probabilities([html_blocks.encode_page(blocks)], trained)
        assert [x >= 0.5 for x in p] == [html_blocks.markup_label(b.path) for b in blocks]


def test_nothing_to_learn_from(pages):
    """No page names its main text: the network still reads the ordinary layouts."""
    weights = html_blocks.train(["<div><p>Nothing that says what this is.</p></div>"])
    for name in ("section article", "primary", "grid", "deep grid", "main role", "table layout", "article wrapped", "docs"):
        kept, wrong = shares(weights, SKELETONS[name], pages[190:])
        assert kept >= 0.95 and wrong <= 0.02
