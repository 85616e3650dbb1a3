"""SimHash components, repeated substrings and fuzzy lines against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from tablekeep.llm import common, line_dedup, simhash, suffix_dedup

from .conftest import EDGE, SF001, make_docs


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_near_duplicates_edge_rows(spark, edge):
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(edge).collect())
    fps = [brute_fingerprint(t) for _, t in EDGE]
    root = brute_components(len(EDGE), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    low = {}
    for r, (i, _) in zip(root, EDGE):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    assert got == Counter((i, f, low.get(r)) for (i, _), f, r in zip(EDGE, fps, root))
    assert brute_fingerprint(None) == 0


def test_links_are_complete(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(60):  # families around a centre, of 0 to 4 flipped bits, and chains
        f = rng.getrandbits(64)
        for _ in range(12):
            g = f
            for b in rng.sample(range(64), rng.randint(0, 4)):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps | {0, (1 << 64) - 1, 1, 3, 7})
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    got = {(r.fp & (1 << 64) - 1): r.root for r in simhash.classes(df).collect()}
    root = brute_components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    classes = {}
    for f, r in zip(fps, root):
        classes.setdefault(r, set()).add(got[f])
    assert all(len(c) == 1 for c in classes.values())
    assert len({next(iter(c)) for c in classes.values()}) == len(classes)


def test_components_on_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1100)}}


def test_representatives_keep_one_of_each_component(spark, edge):
    kept = simhash.representatives(edge)
    assert kept.columns == edge.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    classes = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(edge).collect()}
    held = [classes[i, int(np.uint64(brute_fingerprint(t)).astype(np.int64))] for i, t in rows]
    assert sorted(held) == sorted(set(classes.values()))
    assert all(i == c for (i, _), c in zip(rows, held))


def brute_substrings(rows):
    out = []
    texts = [((1 << 63) - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    for o, b in texts:
        smaller = {x[s:s + 50] for p, x in texts if p < o for s in range(len(x) - 49)}
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if b[s:s + 50] in smaller:
                gone[s:s + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return Counter((i, *x) for (i, _), x in zip(rows, out))


def test_substrings_edge_rows(spark, edge):
    got = Counter(tuple(r) for r in suffix_dedup.dedup_substrings(edge).collect())
    assert got == brute_substrings(EDGE)


def test_substrings_random_overlaps_and_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_DOCUMENTS", 3)  # so that the passages count as hot here
    rng = random.Random(5)

    def chars(n):
        return "".join(rng.choice("abcd é") for _ in range(n))
    passages = [chars(n) for n in (49, 50, 51, 60, 130, 400)]
    rows = []
    for i in range(60):
        text = chars(rng.randint(0, 120))
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            text += p[a:len(p) - rng.randint(0, len(p) // 4)] + chars(rng.randint(0, 30))
        rows.append((i // 2 if i % 7 == 0 else i, text))
    rows += [(100, "ab" * 300), (101, "ab" * 200 + "c"), (99, "a" * 49), (102, "a" * 49)]
    got = Counter(tuple(r) for r in suffix_dedup.dedup_substrings(make_docs(spark, rows).repartition(5)).collect())
    assert got == brute_substrings(rows)


def plain_line(line):
    """The normal form of a line, by characters."""
    kept = "".join("0" if c in "0123456789" else c if ord(c) > 127 or c.isalpha() else " " for c in line.lower())
    return " ".join(x for x in kept.split(" ") if x)


def levenshtein(a, b):
    """Row by row: the best of substitution and deletion, then insertions as a
    running minimum."""
    other, row = np.array([ord(c) for c in b]), np.arange(len(b) + 1)
    steps = np.arange(len(b) + 1)
    for i, c in enumerate(a, 1):
        best = np.concatenate([[i], np.minimum(row[:-1] + (other != ord(c)), row[1:] + 1)])
        row = np.minimum.accumulate(best - steps) + steps
    return int(row[-1])


def alike(norms):
    """All pairs of texts with an edit similarity of at least 0.8. An edit
    spoils three triples of characters at most, which rules most pairs out."""
    size = np.array([len(n) for n in norms])
    counts = np.zeros((len(norms), 4096), np.uint16)
    for row, n in zip(counts, norms):
        for k in range(len(n) - 2):
            row[(ord(n[k]) * 31 + ord(n[k + 1]) * 961 + ord(n[k + 2])) % 4096] += 1
    out = set()
    for i in range(len(norms)):
        longer = np.maximum(size[:i], size[i])
        allowed = longer // 5
        near = np.flatnonzero(np.abs(size[:i] - size[i]) <= allowed)
        shared = np.minimum(counts[near], counts[i]).sum(axis=1, dtype=np.int64)
        for j in near[shared >= longer[near] - 2 - 3 * allowed[near]].tolist():
            if line_dedup.similar(norms[i], norms[j]):  # held against plain distances below
                out.add((i, j))
    return out


def brute_lines(rows):
    """Removed line numbers of each different (id, text)."""
    seen = {}
    for i, t in set(rows):
        for no, line in enumerate((t or "").split("\n")):
            n = plain_line(line)
            if n:
                # a null id counts as the smallest
                place = (i is not None, i or 0, int(np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).astype(np.int64)), no)
                seen.setdefault(n, []).append((place, i, t))
    norms = sorted(seen)
    links = alike(norms)
    groups = {}
    for n, r in zip(norms, brute_components(len(norms), lambda a, b: (a, b) in links)):
        groups.setdefault(r, []).extend(seen[n])
    gone = {}
    for g in groups.values():
        for place, i, t in sorted(g, key=lambda x: x[0])[1:]:
            gone.setdefault((i, t), []).append(place[3])
    return {k: sorted(v) for k, v in gone.items()}


def test_normal_form():
    for x in ("A  b,c--D9", " Ünï 12\t3 Straße! ", "", "...", "昨日は 雨"):
        assert line_dedup.normalise(x) == plain_line(x)


def test_similar_is_the_exact_decision():
    rng = random.Random(12)
    words = [f"{'abcdefghij'[i % 10] * (1 + i % 7)}é{i}" for i in range(40)]
    pairs = [("", "a"), ("abcd", "abce"), ("abcde", "abcdf"), ("abcdefghij", "abcdefgh"), ("abcdefghij", "abcdefg")]
    for _ in range(400):
        a = [rng.choice(words) for _ in range(rng.randint(1, 25))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            i = rng.randrange(len(b) + 1)
            b[i:i + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
        pairs.append((" ".join(a), " ".join(b)))
    seen = [(line_dedup.similar(x, y), 5 * levenshtein(x, y) <= max(len(x), len(y))) for x, y in pairs]
    assert all(g == w for g, w in seen) and {g for g, _ in seen} == {True, False}
    bound = line_dedup._gram_bound(*map(list, zip(*pairs))).tolist()
    assert all(b or not w for b, (_, w) in zip(bound, seen)) and not all(bound)  # drops none that is similar


def test_very_long_lines_are_verified_in_pieces():
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    b = "".join(c if rng.random() > 0.02 else "x" for c in a)
    c = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    assert [line_dedup.similar(a, x) for x in (b, c, a[:200_000])] == [True, False, False]


def test_simhash_against_plain_counts():
    rng = random.Random(9)
    sizes = np.array([1, 2, 5, 60, 255, 256, 700, 1021])
    hashes = [rng.getrandbits(64) for _ in range(int(sizes.sum()))]
    got, start = line_dedup._simhashes(np.array(hashes, np.uint64), sizes), 0
    for n, g in zip(sizes.tolist(), got.tolist()):
        assert g == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes[start:start + n]) > n)
        start += n


def test_untouched_classes_keep_their_blocks():
    """Pigeonhole: each edit spoils at most two grams a byte of a gram, so fewer
    spoilt grams than blocks leave one block equal."""
    rng = random.Random(10)
    for n in (30, 60, 200, 1000):
        for _ in range(50):
            a = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
            b = a[:-1] + b"#"  # one gram goes, one comes
            keys = [set(line_dedup.line_blocks(*line_dedup._grams([x], line_dedup.GRAM), line_dedup.GRAM)[1].tolist()) for x in (a, b)]
            assert len(keys[0] & keys[1]) >= len(keys[0]) - 4 and keys[0] & keys[1]


def line_rows():
    rng = random.Random(8)
    words = [f"w{i}x" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(40, 80))) for _ in range(12)]
    rows = []
    for i in range(36):
        lines = []
        for _ in range(rng.randint(1, 5)):
            parts = rng.choice(base).split()
            for _ in range(rng.randint(0, 2)):
                parts[rng.randrange(len(parts))] = rng.choice(words)
            lines.append(" ".join(parts) + rng.choice(["", ".", " !"]))
        rows.append((i, "\n".join([*lines, "short line", ""])))
    return rows


def test_lines_against_brute_force(spark, edge):
    for rows, df in ((EDGE, edge), (line_rows(), make_docs(spark, line_rows()).repartition(4))):
        want = brute_lines(rows)
        got = Counter((r.doc_id, r.n_lines, r.n_removed, tuple(r.removed_lines)) for r in line_dedup.dedup_report(df).collect())
        assert got == Counter((i, len((t or "").split("\n")), len(want.get((i, t), [])), tuple(want.get((i, t), []))) for i, t in rows)
        texts = line_dedup.dedup_documents(df)
        assert texts.columns == df.columns
        assert Counter((r.doc_id, r.text) for r in texts.collect()) == Counter(
            (i, None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if no not in want.get((i, t), []))) for i, t in rows)
    assert sum(map(len, brute_lines(line_rows()).values())) > 60  # fuzzy links occur


def test_recall_by_edit_similarity(spark):
    """Lines with one to three words replaced that stay similar are found."""
    rng = random.Random(4)
    lines = sorted({plain_line(x) for r in common.load(spark, SF001, "documents").select("text").collect() for x in (r.text or "").split("\n")})
    words = [w for x in rng.sample(lines, 500) for w in x.split()]
    rows, wanted = [], {}
    for low, high in ((1, 4), (5, 9), (10, 19), (20, 40), (41, 120)):
        pool = [x for x in lines if low <= len(x.split()) <= high]
        for x in rng.choices(pool, k=150):
            for edits in (1, 2, 3):
                parts = x.split()
                for at in rng.sample(range(len(parts)), min(edits, len(parts))):
                    parts[at] = rng.choice(words)
                y = " ".join(parts)
                if x != y and 5 * levenshtein(x, y) <= max(len(x), len(y)):
                    rows += [(len(rows), x + f"\nline pair {edits}"), (len(rows) + 1, y)]
                    wanted.setdefault((low, edits), []).append((x, y))
    found = {}
    lines = sorted({z for pairs in wanted.values() for p in pairs for z in p})
    prints = dict(zip(lines, line_dedup.fingerprints([z.encode() for z in lines], [len(z) for z in lines])))

    def candidates(x, y):
        (kx, fx), (ky, fy) = prints[x] or (b"", 0), prints[y] or (b"", 0)
        shared = len(set(line_dedup._unpack(kx).tolist()) & set(line_dedup._unpack(ky).tolist()))
        size = np.array([len(x), len(y)])
        bits = int(line_dedup._bits(np.array([fx, fy], np.uint64), size, np.array([0]), np.array([1]))[0])
        return shared > 0 and bits <= (line_dedup.ONE_BLOCK_BITS if shared == 1 else line_dedup.MAX_BITS)
    found = {k: sum(candidates(*p) for p in pairs) / len(pairs) for k, pairs in wanted.items()}
    print({k: (round(v, 3), len(wanted[k])) for k, v in found.items()})
    assert all(v >= 0.9 for (low, edits), v in found.items() if low >= 10 or (low == 5 and edits <= 2)), found
    # and through the whole operator: what is a candidate is a link
    rows = [(2 * n + k, z) for n, (x, y) in enumerate(wanted[5, 1] + wanted[10, 2]) for k, z in enumerate((x, y))]
    gone = {r.doc_id for r in line_dedup.dedup_report(make_docs(spark, rows)).filter("n_removed > 0").collect()}
    assert sum(2 * n + 1 in gone for n in range(len(rows) // 2)) >= 0.9 * len(rows) / 2


def test_short_lines_and_lines_without_blanks_collapse(spark):
    rows = [(1, "Read more\n\nok\n昨日は雨が降ったので家で本を読んでいた。夜には友達が来た"), (2, "read more!\n\nno"),
            (3, "昨日は雨が降ったので家で本を読んでいた。夜には友達が来た\nOK"), (4, "read mode\nok so")]
    got = {r.doc_id: r.removed_lines for r in line_dedup.dedup_report(make_docs(spark, rows)).collect()}
    assert got == {1: [], 2: [0], 3: [0, 1], 4: [0]}  # "read mode" is 8/9 alike


def hot_rows():
    """Lines that share blocks in large numbers: families of variants, and one
    phrase within otherwise different lines."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    words = [word() for _ in range(400)]
    phrase = "to be read with great care by all who come"
    rows = [(i, f"{phrase} {rng.choice(words)} {rng.choice(words)}") for i in range(90)]
    rows += [(100 + i, f"{' '.join(rng.choice(words) for _ in range(12))} {phrase} {' '.join(rng.choice(words) for _ in range(12))}") for i in range(120)]
    return rows


def test_large_blocks_lose_no_link(spark, monkeypatch):
    want = brute_lines(hot_rows())
    assert len(want) > 60
    for small, tile in ((64, 4096), (4, 16), (1, 7)):
        monkeypatch.setattr(line_dedup, "SMALL", small)
        monkeypatch.setattr(line_dedup, "TILE", tile)
        got = {r.doc_id: tuple(r.removed_lines) for r in line_dedup.dedup_report(make_docs(spark, hot_rows())).collect()}
        assert got == {i: tuple(want.get((i, t), [])) for i, t in hot_rows()}, (small, tile)


def test_variants_in_one_block_give_few_pairs(spark, monkeypatch):
    """Two thousand variants of a line: links grow with the lines, not their square."""
    made = []
    verified = line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *a: made.append(pairs.count()) or verified(pairs, *a))
    rng = random.Random(5)
    base = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    rows = [(i, " ".join([*base[:k], f"v{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", *base[k + 1:]])) for i in range(2000) for k in [rng.randrange(40)]]
    gone = line_dedup.dedup_report(make_docs(spark, rows)).filter("n_removed > 0").count()
    assert gone == 1999 and sum(made) < 20 * 2000, made


def test_empty_tables(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.representatives(empty).count() == 0
    assert suffix_dedup.dedup_substrings(empty).count() == 0
    assert line_dedup.dedup_report(empty).count() == 0
    assert line_dedup.dedup_documents(empty).count() == 0


def test_nothing_is_broadcast_or_collected_for_components(spark):
    edges = spark.range(2000).select((F.col("id") * 2).alias("a"), (F.col("id") * 2 + 1).alias("b"))
    assert common.components(edges).count() == 4000


def test_no_link_within_a_block_is_left_out(spark):
    """Lines that share blocks are linked whatever their SimHashes, one common
    block or many, small block or large."""
    rng = random.Random(77)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    phrase = "to be read with great care by all who come"
    found = 0
    for families in (40,):
        rows = []
        for _ in range(families):
            x = f"{' '.join(word() for _ in range(5))} {phrase} {' '.join(word() for _ in range(5))}"
            for _ in range(3):
                y = list(x)
                for at in rng.sample(range(len(y)), rng.randint(0, len(y) // 6)):
                    y[at] = rng.choice("abcdefghijklmnopqrstuvwxyz")
                rows.append((len(rows), "".join(y)))
        lines = [plain_line(t) for _, t in rows]
        prints = line_dedup.fingerprints([z.encode() for z in lines], [len(z) for z in lines])
        keys = [set(line_dedup._unpack(p[0]).tolist()) for p in prints]
        linked = lambda i, j: keys[i] & keys[j] and 5 * line_dedup.edit_distance(lines[i], lines[j]) <= max(len(lines[i]), len(lines[j]))  # noqa: B023, E731
        root = brute_components(len(rows), linked)
        got = {r.doc_id for r in line_dedup.dedup_report(make_docs(spark, rows)).filter("n_removed > 0").collect()}
        assert got == {i for i in range(len(rows)) if root[i] != i}
        # links that the bits of the SimHashes alone would leave out
        fps, sizes = np.array([p[1] for p in prints], np.uint64), np.array([len(z) for z in lines])
        found += sum(bool(linked(i, j)) and line_dedup._bits(fps, sizes, np.array([i]), np.array([j]))[0] > line_dedup.MAX_BITS
                     for i in range(len(rows)) for j in range(i))
    assert found > 0


def test_a_block_of_variants_gives_as_many_links_as_lines():
    rows = [(1, 0, 0, 0, i, i, 60, f"{'a common line of many words ' * 2}{i:04d}") for i in range(900)]
    columns = [pa.array(c) for c in zip(*rows)]
    batch = pa.RecordBatch.from_arrays(columns, names=["key", "t1", "t2", "tile", "lid", "root", "n", "norm"])
    assert sum(b.num_rows for b in line_dedup._block_links(iter([batch.slice(0, 500), batch.slice(500)]))) == 899
