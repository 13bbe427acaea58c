"""Profiles, registry, run, sinks, store."""

import pytest

from quire.plans import config, registry, store
from quire.plans.checks import CHECKS
from quire.plans.profiles import PROFILES


def test_inheritance_rules():
    p = {"a": {"modules": ["x"], "s": {"k": 1, "l": [1]}, "tracks": {"t": {}}}, "b": {"extends": "a", "modules": ["y", "x"], "s": {"l": [2], "k": None}}, "c": {"extends": ["b"], "modules_replace": ["z"], "s_replace": {"only": 1}}}
    b = config.resolved("b", p)
    assert b["modules"] == ["x", "y"] and b["s"] == {"k": None, "l": [2]} and b["lineage"] == ["a", "b"]
    c = config.resolved("c", p)
    assert c["modules"] == ["z"] and c["s"] == {"only": 1}
    with pytest.raises(config.ConfigError, match="circle"):
        config.resolved("x", {"x": {"extends": "y"}, "y": {"extends": "x"}})
    with pytest.raises(config.ConfigError):
        config.resolved("nowhere", p)


def test_track_null_removes():
    p = {"s": {"k": 3}, "tracks": {"t": {"settings": {"s": {"k": None}}}}}
    assert config.setting(p, "s.k", 9) == 3 and config.setting(p, "s.k", 9, "t") is None and config.setting(p, "s.z", 9) == 9


@pytest.mark.parametrize("bad", [{}, {"tracks": {"t": {}}, "default_track": "u"}, {"tracks": {"t": {}}, "severity_overrides": {"c": "fatal"}}])
def test_validation(bad):
    with pytest.raises(config.ConfigError):
        config.validated(bad)


def test_bundled_profiles_resolve():
    assert all(config.validated(config.resolved(k, PROFILES)) for k in PROFILES)
    assert config.resolved("baylearn", PROFILES)["columns"] == 1


def test_failed_check_is_skipped_and_pass_is_never_remapped(spark):
    r = registry.Registry()

    @r.register("good", "Good", module="m.a")
    def good(tables, profile):
        return spark.createDataFrame([(1, "pass", "fine"), (1, "warning", "hm")], "doc_id long, severity string, message string")

    @r.register("bad", "Bad", module="m.b")
    def bad(tables, profile):
        raise RuntimeError("no")

    @r.register("off", "Off", module="n")
    def off(tables, profile):
        raise AssertionError

    with pytest.raises(ValueError, match="twice"):
        r.register("good", "Again", module="m")(good)
    out = r.run(spark, lambda t: None, {"modules": ["m"], "severity_overrides": {"good": "error"}})
    assert sorted((x.check_id, x.severity) for x in out.collect()) == [("bad", "skipped"), ("good", "error"), ("good", "pass")]
    counts = {(x.doc_id, x.severity): x.n for x in registry.severity_counts(out.filter("doc_id = 1")).collect()}
    assert counts == {(1, "error"): 1, (1, "warning"): 0, (1, "pass"): 1, (1, "skipped"): 0, (1, "unverifiable"): 0}
    assert r.run(spark, lambda t: None, {"modules": []}).count() == 0


def test_flags_gate_checks():
    p = config.resolved("arr", PROFILES)
    ids = {c.id for c in CHECKS.selected(p)}
    assert "reference_verification" not in ids and "reference_verification" in {c.id for c in CHECKS.selected(p, frozenset({"refcheck"}))}


def test_store_and_sinks(spark, tmp_path):
    f = spark.createDataFrame([(1, "c", "T<", "g", "error", "a & b", 1.0, 1, None), (1, "d", "U", "g", "pass", "ok", None, None, None)], registry.FINDINGS)
    path = str(tmp_path / "runs")
    store.save(f, path, "r1")
    store.save(f, path, "r2")
    assert store.load(spark, path, "r1").count() == 2
    assert "✗ **T<**: a & b" in store.markdown(f).first().markdown
    assert "T&lt;" in store.html(f).first().html
    assert '"severity":"error"' in " ".join(r.value for r in store.json_lines(f).collect())
    assert [r.number for r in registry.numbered(f).orderBy("number").collect()] == [1, 2]


def test_run_listing(spark):
    runs = spark.createDataFrame([(f"r{i}", "p/a.pdf", i) for i in range(5)] + [("s", "p/b.pdf", 9)], "run_id string, path string, saved_at int")
    assert {r.run_id for r in store.latest_runs(runs).collect()} == {"r4", "s"}
    assert {r.run_id for r in store.pruned(runs, 2).collect()} == {"r0", "r1", "r2"}
    assert store.resolve(runs, "b.pdf").count() == 1 and store.resolve(runs, "latest").first().run_id == "s" and store.resolve(runs, "r2").count() == 1
