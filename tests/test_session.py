from types import SimpleNamespace

import pytest

from wardline.session import ensure_checkpoint_dir, is_local_master


def fake_session(master, folder=None):
    state = {"dir": None}
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: state["dir"],
                         setCheckpointDir=lambda d: state.update(dir=d))
    conf = SimpleNamespace(get=lambda key, default=None: folder or default)
    return SimpleNamespace(sparkContext=sc, conf=conf)


def test_only_one_jvm_masters_are_local():
    assert is_local_master("local") and is_local_master("local[4]")
    assert not is_local_master("local-cluster[3,2,1024]") and not is_local_master("yarn")


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(fake_session("yarn"))


def test_the_named_folder_is_used_on_any_master():
    assert ensure_checkpoint_dir(fake_session("yarn", "store:///shared")) == "store:///shared"
