"""What operators write for themselves goes when the workspace they ran in is closed."""

import os

import pytest

from ballast.plans import queries
from ballast.session import shared_dir, workspace, written

# Queries that write tables of their own, for requests over a horizon and for live tables, and one that need not.
WRITERS = ["staging_in_horizon", "backfill_ledger", "stream_conditions"]
NAMES = [*WRITERS, "payload_checksums"]


def files(folder):
    return [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names]


@pytest.mark.parametrize("name", NAMES)
def test_nothing_stays_behind(spark, sf_dir, tmp_path, name):
    with workspace(spark) as root:
        with workspace(spark) as folder:
            queries.REGISTRY[name](spark, sf_dir).write.parquet(f"{tmp_path}/out")
            assert name not in WRITERS or files(folder)
        assert not os.path.exists(folder) and not files(root)
    assert spark.read.parquet(f"{tmp_path}/out").count() == queries.REGISTRY[name](spark, sf_dir).count()


def test_a_failed_block_is_cleared_and_blocks_nest(spark):
    with pytest.raises(ZeroDivisionError), workspace(spark) as outer:
        kept = written(spark.range(3))
        with workspace(spark) as inner:
            written(spark.range(4))
            assert inner.startswith(outer) and files(inner)
        assert not os.path.exists(inner) and kept.count() == 3
        1 / 0
    assert not os.path.exists(outer)
    assert not shared_dir(spark).startswith(outer)
