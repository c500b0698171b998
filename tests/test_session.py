"""Checkpoint-folder rules: read the session's setting, invent one only locally."""

import pytest

from perkflow.session import checkpoint_root


class _Opt:
    def __init__(self, v):
        self.v = v

    def isDefined(self):
        return self.v is not None

    def get(self):
        return self.v


class _FakeSpark:
    def __init__(self, conf_dir, master, ctx_dir=None):
        outer = self

        class Conf:
            def get(self, key, default=None):
                return conf_dir if key == "spark.checkpoint.dir" and conf_dir else default

        class SC:
            def __init__(self):
                self.master = master
                self.set_to = None
                sc = self

                class J:
                    def sc(self):
                        class S:
                            def getCheckpointDir(self):
                                return _Opt(ctx_dir)
                        return S()
                self._jsc = J()

            def setCheckpointDir(self, p):
                self.set_to = p

        self.conf = Conf()
        self.sparkContext = SC()


def test_uses_configured_folder():
    assert checkpoint_root(_FakeSpark("hdfs://namenode/shared/ckpt/", "yarn")) == "hdfs://namenode/shared/ckpt"


def test_cluster_without_setting_fails():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(_FakeSpark(None, "yarn"))


def test_local_without_setting_gets_private_folder():
    fake = _FakeSpark(None, "local[4]")
    path = checkpoint_root(fake)
    assert path and fake.sparkContext.set_to == path


def test_context_dir_is_used():
    assert checkpoint_root(_FakeSpark(None, "k8s://x", ctx_dir="hdfs://nn/ckpt/uuid")) == "hdfs://nn/ckpt/uuid"
