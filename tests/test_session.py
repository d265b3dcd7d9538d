from promspark.session import scale_settings


def test_scale_settings_for_100tb_on_1000_executors():
    s = scale_settings(100 * 1024 ** 4, 8000)
    parts = int(s["spark.sql.shuffle.partitions"])
    assert 100 * 1024 ** 4 // parts <= 256 * 1024 ** 2          # ~256 MB per shuffle partition
    assert s["spark.sql.adaptive.enabled"] == "true" and s["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert int(s["spark.sql.autoBroadcastJoinThreshold"]) == 32 * 1024 ** 2


def test_scale_settings_small_input_keeps_all_cores_busy():
    s = scale_settings(10 * 1024 ** 2, 64)
    assert int(s["spark.sql.shuffle.partitions"]) == 64 * 3
