import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.01"
#: Columns that operators use inside; as extra columns they must not disturb.
CLASHING = ["score", "fp", "db", "sidx", "size", "start", "key", "hash", "kept", "root", "tile", "kind", "at", "pos"]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars int, "
          + ", ".join(f"{c} string" for c in CLASHING))

PROSE = ("the river runs past the old mill and under the stone bridge where children fish in summer while "
         "carts of grain cross slowly toward the market town beyond the hills every second morning of the week")


def long_text(n=6000):
    return " ".join(f"{PROSE.split()[(i * 7 + i // 5) % 34]}{i % 97}" for i in range(n))


EDGE = [
    (1, PROSE), (2, PROSE), (2, PROSE), (3, PROSE.replace("stone", "wooden")), (4, None), (5, ""), (6, "   \n\t \r\n"),
    (7, "one"), (8, "two words"), (None, PROSE), (None, None), (9, long_text()), (10, long_text() + " tail of it"),
    (11, "A\nA\n\nB line of five words here\nA"), (12, PROSE + "\n" + PROSE), (13, "x" * 400), (14, "ÄÖ ü   ñ \x1f ends"),
    (2, "another text under the same id " + PROSE[:90]), (15, "*** ### $$$ %%% &&& ||| <<< >>> *** ### $$$ %%%"),
    (16, "in 2019 Mr Smith paid 300 dollars, then Mr Smith paid 300 dollars again for 12 km of road near the mill"),
]


def make_docs(spark, rows):
    data = [(i, t, "en", None if (i or 0) % 5 == 0 else f"s{(i or 0) % 3}", None if t is None else len(t), *["x"] * len(CLASHING))
            for i, t in rows]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="session")
def spark():
    from tablekeep.session import local_session
    s = local_session(cores="*", shuffle_partitions=4)
    yield s


@pytest.fixture()
def edge(spark):
    return make_docs(spark, EDGE).repartition(3)


@pytest.fixture()
def empty(spark):
    return make_docs(spark, [])
