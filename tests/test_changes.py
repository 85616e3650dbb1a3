"""Change sets and tables as of a time."""

import random

from tablekeep.operators import changes
from tablekeep.sources import dump


def frame(spark, rows):
    return spark.createDataFrame([(*k, v, None if v % 3 else f"t{v}") for k, v in rows.items()], "a long, b string, v long, t string").repartition(3)


def bag(df):
    return sorted(map(str, df.collect()))


def test_state_at_every_time(spark, tmp_root):
    rng = random.Random(3)
    now = {(i, rng.choice(["x", "y", None])): i for i in range(120)} | {(None, "n"): 1}
    states = [dict(now)]
    for step in range(3):
        for k in rng.sample(sorted(now, key=str), 25):
            if rng.random() < 0.4:
                del now[k]
            else:
                now[k] += 1000
        now |= {(500 + step * 10 + i, "new"): i for i in range(5)}
        states.append(dict(now))
    frames = [frame(spark, s) for s in states]
    keys = ["a", "b"]
    sets = [changes.change_set(x, y, keys, t) for t, (x, y) in enumerate(zip(frames, frames[1:]), 1)]
    for (x, y), s in zip(zip(states, states[1:]), sets):
        assert s.count() == sum(x.get(k) != y.get(k) for k in {*x, *y})
    whole = sets[0].unionByName(sets[1]).unionByName(sets[2])
    dump.write_dump({"t": whole}, f"{tmp_root}/changes", "2024-01-01T00:00:00+00:00")  # change sets are dumped like tables
    back = dump.read_dump(spark, f"{tmp_root}/changes")["t"]
    for t, want in enumerate(frames):
        assert bag(changes.state_at(frames[0], back.unionByName(sets[0]), keys, t)) == bag(want)  # one set twice


def test_equal_and_empty_tables(spark):
    some = frame(spark, {(i, "x"): i for i in range(9)})
    none = some.limit(0)
    assert changes.change_set(some, some, ["a", "b"], 1).count() == 0
    assert bag(changes.state_at(some, changes.change_set(some, none, ["a", "b"], 1), ["a", "b"], 1)) == []
    assert bag(changes.state_at(none, changes.change_set(none, some, ["a", "b"], 1), ["a", "b"], 1)) == bag(some)
