import os
import weakref

import pytest

from chatloom import session


def test_materialized_tables_can_be_cleared(spark):
    kept, mine = dict(session._written), [session.materialize(spark.range(n), "t") for n in (5, 6, 7)]
    assert [df.count() for df in mine] == [5, 6, 7]
    paths = [p for p in session._written if p not in kept]
    session.discard(mine[0])
    assert paths[0] not in session._written and not os.path.exists(paths[0])
    session._written.clear()
    session._written.update({p: weakref.ref(df) for p, df in zip(paths[1:], mine[1:], strict=True)})
    session.clear_materialized(spark, mine[2])
    assert list(session._written) == paths[2:] and mine[2].count() == 7 and not os.path.exists(paths[1])
    session._written.update(kept)


def test_a_cluster_must_name_a_shared_folder():
    class Far:
        conf = {}
        sparkContext = type("", (), {"master": "spark://far:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Far)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["status", "conversations", "assistant_messages", "messages"]
