"""Where written intermediates may go."""

import pytest

from granary.session import shared_folder


class Session:
    def __init__(self, **settings):
        self.settings = {k.replace("_", "."): v for k, v in settings.items()}
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def set(self, key, value):
        self.settings[key] = value


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "yarn", "spark://host:7077"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(RuntimeError):
        shared_folder(Session(spark_master=master))


def test_the_given_folder_is_used():
    session = Session(spark_master="yarn", spark_checkpoint_dir="hdfs:///shared")
    assert shared_folder(session).startswith("hdfs:///shared/")


def test_a_local_session_gets_a_folder():
    assert shared_folder(Session(spark_master="local[2]"))
