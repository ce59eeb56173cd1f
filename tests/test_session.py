"""The shared folder: named on a cluster, of the session's own only in one process."""

from types import SimpleNamespace

import pytest

from rosterlake.session import shared_dir


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(master, configured=None):
    return SimpleNamespace(sparkContext=Context(master), conf=SimpleNamespace(get=lambda key, default: configured or default))


def test_a_cluster_must_name_its_shared_folder():
    for master in ("spark://host:7077", "local-cluster[3,2,1000]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
        assert shared_dir(session(master, "hdfs://x/shared")) == "hdfs://x/shared"


def test_one_process_may_do_without():
    for master in ("local", "local[8]", "local[*]"):
        assert "rosterlake-" in shared_dir(session(master))
