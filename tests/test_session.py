"""Session helpers keep what the deployment has set."""

import pytest

from pagelane import session


def test_settings_of_a_running_session_stay(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "777")
        again = session.build_session()
        assert again is spark and again.conf.get("spark.sql.shuffle.partitions") == "777"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
    assert session.is_local("local[4]") and session.is_local("local") and not session.is_local("local-cluster[3,2,1024]")


def test_spread_only_on_request(spark):
    from pagelane.operators.balance import spread
    df = spark.range(10).coalesce(1)
    assert spread(df, ["id"]) is df
    assert spread(df, ["id"], 5).rdd.getNumPartitions() == 5
