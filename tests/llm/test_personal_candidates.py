"""Candidates of personal data: whole at any length, and the known kinds of keys."""

import pytest

from planlens.llm import pii

WHOLE = {
    "y" * 80 + " [at] example [dot] com": "<EMAIL>",
    "write x" + "a" * 80 + " at " + "b" * 70 + " dot com please": "write <EMAIL> please",
    "a[at]b" + "(dot)cd" * 12 + ".": "<EMAIL>.",
    "key ghp_16C7e42F292c6912E7710c838347Ae178B4a": "key <SECRET>",
    "use sk-abcdEFGH1234ijklMNOP5678 now": "use <SECRET> now",
    "bot xoxb-123456789012-abcdefGHIJ": "bot <SECRET>",
    "jwt eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U": "jwt <SECRET>",
    "PASSWORD=hunter22x": "<SECRET>",
    "Password: hunter22x": "<SECRET>",
    "password = hunter22x, then": "<SECRET> then",
    "the secret: nothing here": "the secret: nothing here",
    "flat]x pwd=flat]x99": "flat]x <SECRET>",
}


@pytest.fixture(scope="module")
def masked(spark, data):
    """Among real documents, from which the labelers learn."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    texts = list(WHOLE)
    more = spark.createDataFrame([(10**7 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return {texts[r["doc_id"] - 10**7]: r["text"] for r in pii.masked(docs.unionByName(more)).filter("doc_id >= 10000000").collect()}


@pytest.mark.parametrize("text", list(WHOLE))
def test_candidate(masked, text):
    assert masked[text] == WHOLE[text]


def test_patterns_have_no_upper_bound():
    """Nothing of an address or a value is left behind because it is long."""
    assert not [p for kind in ("email", "secret") for p in (pii.CANDIDATES[kind],) if "{1," in p]


def score_of(weights, kind, votes, features):
    """The classifier's sum, term by term."""
    return sum(weights.get(key, 0.0) for key in ((kind, "prior", ""), (kind, "votes", "/".join(map(str, votes))), *((kind, f, features[f]) for f in pii.FEATURES)))


def test_added_spans_are_those_with_a_positive_score(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scanned = pii.scan(docs).cache()
    weights = pii.classifier(scanned)
    want = {}
    for r in scanned.collect():
        base = [tuple(s) for s in r["base"] or ()]
        more = []
        for c in r["candidates"] or ():
            free = not any(k == c["kind"] and s < c["end"] and c["start"] < e for k, s, e in base)
            if free and score_of(weights, c["kind"], [c[v] for v in pii.LABELERS], c) > 0:
                more.append((c["kind"], c["start"], c["end"]))
        want[r["doc_id"]] = sorted(base + more, key=lambda s: (pii.KINDS.index(s[0]), s[1:]))
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.with_spans(scanned, weights).collect()}
    assert got == want and any(len(want[r["doc_id"]]) > len(r["base"] or ()) for r in scanned.collect())
