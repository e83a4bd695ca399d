"""Pinned functions and templates: refusals before anything is made, and digests of rows equal to the driver's."""

import json

import pytest

from planlens.functions.registry import Catalog, Module, resolved
from planlens.registry_queries import CATALOG


def test_install_is_all_or_nothing(spark):
    pins = {a: CATALOG.modules[a].digest() for a in ("upper_text", "reversed_text")}
    changed = Catalog({**CATALOG.modules, "reversed_text": Module("text.reverse", "1", "STRING", "STRING", "reverse(trim(x))"), "first_text": Module("text.first", "1", "STRING", "STRING", "left(x, 1)")})
    with pytest.raises(ValueError, match="DIGEST_MISMATCH: reversed_text"):
        changed.install(spark, {"first_text": None, **pins})
    assert not [f for f in spark.catalog.listFunctions() if f.name == "first_text"]
    with pytest.raises(ValueError, match="NOT_REGISTERED"):
        CATALOG.install(spark, {"other": None})
    CATALOG.install(spark, pins)
    assert spark.sql("SELECT upper_text(x) AS u, reversed_text(x) AS r FROM VALUES ('ab'), (NULL) AS t(x)").collect() == [("AB", "ba"), (None, None)]


def test_templates_in_sql(spark):
    config = {"mark": "it's \\ \"q\"", "times": 3}
    CATALOG.install(spark, {"marked_text": CATALOG.modules["marked_text"].digest(config)}, {"marked_text": config})
    assert spark.sql("SELECT marked_text(x) AS m FROM VALUES ('a') AS t(x)").first()["m"] == config["mark"] * 3 + "a"
    for bad in (None, {}, {"mark": 1}, {"mark": "a", "times": "2"}, {"mark": "a", "more": 1}):
        with pytest.raises(ValueError, match="CONFIG_INVALID"):
            CATALOG.modules["marked_text"].digest(bad)
    with pytest.raises(ValueError, match="CONFIG_NOT_ACCEPTED"):
        CATALOG.modules["upper_text"].digest({"a": 1})
    with pytest.raises(ValueError, match="stable name"):
        Catalog({"Not one": CATALOG.modules["upper_text"]})


def test_rows_resolve_as_the_driver_does(spark):
    configs = [None, "{}", "null", "[]", "x", '{"mark":"a"}', '{"times":3,"mark":"\\u00e9\\n"}', '{"mark":null}', '{"mark":"a","times":"2"}', '{"mark":"a","more":1}']
    rows = [(k, alias, pin, c) for k, (alias, pin, c) in enumerate((a, p, c) for a in ("upper_text", "marked_text", "other", None) for p in (None, "0" * 64, CATALOG.modules["upper_text"].digest()) for c in configs)]
    got = {r["k"]: (r["defect"], r["digest"]) for r in resolved(spark.createDataFrame(rows, "k int, alias string, pin string, config string"), CATALOG).collect()}
    assert len(got) == len(rows)
    for k, alias, pin, config in rows:
        try:
            held = None if config is None else json.loads(config)
        except ValueError:
            held = "x"
        digest, want = None, None
        try:
            if alias == "upper_text" and held not in (None, {}):
                raise ValueError("CONFIG_NOT_ACCEPTED: any")
            digest = CATALOG.modules[alias].digest(held) if alias in CATALOG.modules else None
            CATALOG.checked(alias, pin, held)
        except ValueError as e:
            want = str(e).split(":")[0]
        assert got[k] == (want, digest), (alias, pin, config)
