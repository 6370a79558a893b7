from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest

from tillfloor.session import Scratch, clear_staging, stage, staging_folder


def test_staged_rows_stay_until_they_are_cleared(spark):
    staged = stage(spark.range(5))
    folder = Path(staging_folder(spark).removeprefix("file:"))
    assert staged.count() == 5 and any(folder.iterdir())
    clear_staging(spark)
    assert not folder.exists()
    assert stage(spark.range(3)).count() == 3


def test_scratch_ends_with_its_block(spark):
    with Scratch(spark) as scratch:
        one = scratch.stage(spark.range(5))
        kept = stage(one.selectExpr("id * 2 AS id").union(scratch.stage(spark.range(2))))
        folder = Path(scratch.folder.removeprefix("file:"))
        assert len(list(folder.iterdir())) == 2
    assert not folder.exists() and kept.count() == 7


def test_scratch_is_deleted_after_an_error_too(spark):
    with pytest.raises(KeyError), Scratch(spark) as scratch:
        scratch.stage(spark.range(1))
        raise KeyError
    assert not Path(scratch.folder.removeprefix("file:")).exists()


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "yarn", "spark://host:7077"])
def test_several_processes_need_a_shared_folder(master):
    context = SimpleNamespace(master=master, applicationId="a", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf={"spark.checkpoint.dir": None})
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        staging_folder(session)
