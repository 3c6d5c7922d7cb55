"""Scratch space follows the session's checkpoint folder."""

import tempfile

from gauntlet.session import checkpoint_root, scratch_dir


def test_scratch_lives_under_the_session_checkpoint_dir(spark):
    sc = spark.sparkContext
    before = sc.getCheckpointDir()
    shared = tempfile.mkdtemp(prefix="t-shared-")
    sc.setCheckpointDir(shared)
    try:
        root = checkpoint_root(spark)
        assert shared in root  # the session's setting is used, not replaced
        a, b = scratch_dir(spark, "x"), scratch_dir(spark, "x")
        assert a.startswith(root) and b.startswith(root) and a != b  # fresh folder per call
    finally:
        if before:
            sc.setCheckpointDir(before)
