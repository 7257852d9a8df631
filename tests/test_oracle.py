"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import os

import pytest

from tests.conftest import SF_SMALL

pytestmark = pytest.mark.skipif(os.environ.get("HYDROFRAME_SKIP_ORACLE") == "1", reason="oracle run skipped")


def test_all_queries_match_oracle(spark):
    from tools.compare import compare
    from hydroframe.plans.queries import REGISTRY
    res = compare(spark, SF_SMALL, list(REGISTRY), verbose=False)
    bad = {k: v for k, v in res.items() if not (v.startswith("OK") or v.startswith("rows-only"))}
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "event_count" in df.columns


def test_column_types_match_oracle(spark):
    from tools.compare import duck
    from tools.types import SPARK_TO_DUCK
    import __spark_entry__ as E
    con = duck(SF_SMALL)
    qs, sql = E.queries(), E.oracle_sql()
    bad = {}
    from hydroframe.plans.queries import REGISTRY
    for name, text in sql.items():
        if name not in REGISTRY:
            continue
        s = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
             for f in qs[name](spark, SF_SMALL).schema.fields}
        d = {r[0]: r[1] for r in con.execute(f"DESCRIBE {text}").fetchall()}
        if s != d:
            bad[name] = {k: (s.get(k), d.get(k)) for k in set(s) | set(d) if s.get(k) != d.get(k)}
    assert not bad, bad
