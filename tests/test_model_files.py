"""Model files and the filter context: what is accepted, and that everything else is an error of ours."""

from datetime import date, datetime

import pytest
import yaml
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.errors import SemanticsError
from plumbline.functions import calendar as cal
from plumbline.plans.modelload import load_models, models_from
from plumbline.plans.scope import All, Between, Eq, In, LastPeriods, Scope, all_, context, last, not_

GOOD = """
dimensions:
  place: {table: core.places, key_column: code, attributes: {town: town_name, area: area}, hierarchy: [town, area]}
visits:
  fact: core.visits
  time: {column: day, cadence: weekly}
  dimensions: {kind: kind_code, place: {shared: place_code}}
  measures:
    visits: {expr: count(*), description: all}
    long: {expr: count(*), where: minutes > 60, description: long ones}
    share: {ratio: {num: count(*) FILTER (WHERE minutes > 60), den: {sum: minutes, where: minutes > 0}}, description: share}
"""


def load(text):
    return models_from([("t.yml", yaml.safe_load(text))])


def test_good():
    m = load(GOOD)["visits"]
    assert m.measures["long"].text == "count(*) FILTER (WHERE minutes > 60)"
    assert m.measures["share"].den == "sum(minutes) FILTER (WHERE minutes > 0)"
    assert m.measures["visits"].time_agg == "sum" and not m.measures["share"].additive
    assert m.dims["place"].shared.attributes == {"town": "town_name", "area": "area"}


@pytest.mark.parametrize(
    "old, new, say",
    [
        ("fact: core.visits", "fakt: core.visits", "did you mean 'fact'"),
        ("expr: count(*), description: all", "expr: count(*)", "description is required"),
        ("{expr: count(*), description: all}", "{expr: count(*), ratio: {num: a, den: b}, description: x}", "exactly one"),
        ("place: {shared: place_code}", "place: place_code", "shared dimension"),
        ("place: {shared: place_code}", "shop: {shared: place_code}", "no shared dimension"),
        ("kind: kind_code", "visits: kind_code", "both a dimension and a measure"),
        ("kind: kind_code", "period: kind_code", "reserved"),
        ("kind: kind_code", "__k: kind_code", "reserved"),
        ("hierarchy: [town, area]", "hierarchy: [street]", "hierarchy"),
        ("cadence: weekly", "cadence: hourly", "cadence"),
        ("where: minutes > 60, description", "time_agg: avg, description", "time_agg"),
        ("fact: core.visits", "snapshot: true\n  fact: core.visits\n  strict_context: 1", "true or false"),
        ("expr: count(*), where: minutes > 60", "expr: sum(x) FILTER (WHERE y), where: minutes > 60", "FILTER of its own"),
        ("{sum: minutes, where: minutes > 0}", "{sum: distinct minutes}", "DISTINCT"),
        ("{sum: minutes, where: minutes > 0}", "{sum: minutes, nulls: zero}", "ignore or propagate"),
    ],
)
def test_mistakes(old, new, say):
    assert old in GOOD
    with pytest.raises(SemanticsError, match=say):
        load(GOOD.replace(old, new))


def test_snapshot_sums_are_refused():
    text = GOOD.replace("fact: core.visits", "snapshot: true\n  fact: core.visits")
    assert load(text)["visits"].measures["visits"].time_agg == "last"
    with pytest.raises(SemanticsError, match="snapshot"):
        load(text.replace("description: all", "description: all, time_agg: sum"))


def test_files_merge(tmp_path):
    (tmp_path / "a.yml").write_text(GOOD)
    (tmp_path / "b.yaml").write_text("calls: {fact: core.calls, time: {column: day}, measures: {n: {expr: count(*), description: x}}}")
    assert set(load_models(tmp_path)) == {"visits", "calls"}
    (tmp_path / "c.yml").write_text("calls: {fact: core.calls, time: {column: day}, measures: {n: {expr: count(*), description: x}}}")
    with pytest.raises(SemanticsError, match="declared twice"):
        load_models(tmp_path)


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats() | st.text(max_size=8) | st.dates(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=8) | st.sampled_from(["fact", "time", "measures", "expr", "sum", "dimensions", "shared"]), x, max_size=4), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(values)
def test_any_yaml_loads_or_is_refused(value):
    try:
        models_from([("x", value)])
    except SemanticsError:
        pass


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text(max_size=6), values, max_size=3))
def test_any_context_is_read_or_refused(entries):
    try:
        context(entries)
        Scope(entries)
    except SemanticsError:
        pass


def test_scope():
    s = Scope({"a": 1, "b": ["x", "y"], "time": ("2026-01-01", "2026-02-01")})
    assert s.get("a") == Eq(1) and s.get("b") == In(("x", "y")) and s.get("time") == Between(date(2026, 1, 1), date(2026, 2, 1))
    assert (s | {"a": 2}).get("a") == Eq(2) and s.get("a") == Eq(1)
    assert s.without("a", "b") == Scope({"time": ("2026-01-01", "2026-02-01")}) and hash(s) == hash(Scope(dict(s.items())))
    assert s.to_dict() == {"a": {"eq": 1}, "b": {"in": ["x", "y"]}, "time": {"between": ["2026-01-01", "2026-02-01"]}}
    assert context({"a": {"not": 1}, "time": {"last": {"n": 2, "unit": "week"}}}, b=all_()).get("time") == LastPeriods(2, "week")
    assert context(s.to_dict()) == s
    for bad in ({"a": None}, {"a": []}, {"a": float("nan")}, {"a": [[1]]}, {"time": 3}, {"time": ("2026-02-01", "2026-01-01")}, {"a": last(1, "day")}):
        with pytest.raises(SemanticsError):
            Scope(bad)


@pytest.mark.parametrize("n, unit, lo", [(1, "day", "2026-03-31"), (2, "week", "2026-03-18"), (1, "month", "2026-03-01"), (1, "year", "2025-04-01")])
def test_last_is_anchored(n, unit, lo):
    for anchor in (date(2026, 3, 31), datetime(2026, 3, 31, 17)):
        assert Scope({"time": last(n, unit)}).resolve(lambda a=anchor: a).get("time") == Between(date.fromisoformat(lo), date(2026, 3, 31))


def test_calendar_columns_match_python(spark):
    from pyspark.sql import functions as F

    days = spark.range(0, 800).select(F.date_add(F.lit("2023-12-25").cast("date"), F.col("id").cast("int")).alias("d"))
    for fys in (1, 4, 7, 12):
        row = days.select("d", *[cal.period_of(g, F.col("d"), fys).alias(g) for g in cal.GRAINS], *[cal.last_day_of(g, cal.period_of(g, F.col("d"), fys)).alias(f"{g}_end") for g in cal.GRAINS])
        for r in row.collect():
            for g in cal.GRAINS:
                assert r[g] == cal.period_start(g, r["d"], fys) and r[f"{g}_end"] == cal.period_end(g, r["d"], fys)


def test_not_and_all():
    assert not_("x").value == "x" and isinstance(all_(), All)
