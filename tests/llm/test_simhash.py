import random
import re

import numpy as np
import pytest
import xxhash

from noticelake.llm import simhash as simhash_module
from noticelake.llm.simhash import COARSE_OFFSETS, components, fine_steps, keep_one, near_copies, near_duplicates, simhash, spanning_forest


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def reach(nodes, linked):
    root = {k: k for k in nodes}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in nodes}


def test_offsets_cover_every_fine_offset_once():
    assert len(COARSE_OFFSETS) == 21 and sum(map(len, fine_steps())) == (545 + 1) // 2


def test_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    texts = [None, "", "One", "one", "Two  words", "ünï çödé x", "long " * 30000]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(4, 400))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rows = [(k, x, 1) for k, x in enumerate(texts)] + [(0, None, 2)]
    fps = {k: plain(x) for k, x, _ in rows}
    assert all(simhash(x) == fps[k] for k, x, _ in rows)
    linked = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    expected = reach(list(fps), linked)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id int").repartition(4)
    found = near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.component_id for r in found} == expected
    assert {r.doc_id: r.fp % 2**64 for r in found} == fps
    assert near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("cell_hosts", [1_000_000, 5])
def test_dense_links(spark, monkeypatch, cell_hosts):
    """All fingerprints within two bits of one, and a chain of single bits, in whole cells and split ones."""
    monkeypatch.setattr(simhash_module, "CELL_HOSTS", cell_hosts)
    base = 0x0123456789ABCDEF
    ball = {base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(64)}
    chain = [0]
    for k in range(64):
        chain.append(chain[-1] | 1 << k)
    from noticelake.llm.simhash import links

    values = sorted(ball | set(chain))
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp bigint")
    found = components(links(df)).collect()
    expected = reach(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2])
    assert len({r.root for r in found}) == len(set(expected.values())) and len({r.node for r in found} | {r.root for r in found}) == len(values)


def test_components_of_a_path(spark):
    order = list(range(40))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[k], order[k + 1]) for k in range(39)], "u bigint, v bigint")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(k, 0) for k in range(1, 40)}
    assert components(edges.limit(0)).collect() == []


def test_spanning_forest():
    a, b = spanning_forest(np.array([5, 7, 1], np.uint64), np.array([7, 9, 2], np.uint64))
    assert dict(zip(a.tolist(), b.tolist())) == {7: 5, 9: 5, 2: 1}


def jaccard(a, b):
    sets = []
    for text in (a, b):
        words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_near_copies_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(90)]
    texts = [None, "", " \n", "One", "one", "a b c d", "A  b c d", "long " * 30000]
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(4, 300))] + passage * (rng.random() < 0.5)
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rows = [(k, x, k, "n", "g") for k, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, node bigint, root string, __gone string").repartition(4)
    found = {r.doc_id: r.root for r in near_copies(docs).collect()}
    expected = reach(list(range(len(texts))), [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8])
    groups = {}
    for k, root in found.items():
        groups.setdefault(root, set()).add(k)
    wanted = {}
    for k, root in expected.items():
        wanted.setdefault(root, set()).add(k)
    mine, truth = ({frozenset(g) for g in x.values()} for x in (groups, wanted))
    pairs = lambda gs: {(a, b) for g in gs for a in g for b in g if a < b}
    assert pairs(mine) <= pairs(truth) and len(pairs(mine)) >= 0.97 * len(pairs(truth)) and len(pairs(truth)) > 50
    left = keep_one(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {min(g) for g in groups.values()}
    assert near_copies(docs.limit(0)).collect() == [] == keep_one(docs.limit(0)).collect()


def test_one_row_of_a_group_stays(spark):
    """Repeated ids and rows, null ids: unique texts stay, of each group exactly one row does."""
    a, b = " ".join(f"a{k}" for k in range(100)), " ".join(f"b{k}" for k in range(100))
    rows = [(1, a), (3, a), (3, b), (5, a + " more"), (None, b + " more"), (None, "own text"), (7, "once"), (7, "once"), (8, None), (9, "")]
    left = keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=repr) == sorted([(1, a), (3, b), (None, "own text"), (7, "once"), (8, None)], key=repr)


def groups_of(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.root, set()).add(r.doc_id)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("cell_pairs", [1_000_000, 0])
def test_no_link_is_left_out(spark, monkeypatch, cell_pairs):
    """Pairs at the very threshold, chains whose ends are unlike, and a crowd around one text: groups are those of brute force, exactly."""
    monkeypatch.setattr(simhash_module, "CELL_PAIRS", cell_pairs, raising=False)
    rng = random.Random(11)
    own = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    texts = ["a b c d", "a b c d e", "a b c d e f"]
    for n in range(13, 213):  # one word more at the end of 4 * k shingles: 4 * k of 5 * k in common, or one too few
        base = own(n)
        texts += [" ".join(base), " ".join(base + own((n - 4) // 4 + (n % 3 == 0)))]
    chain = own(120)
    for k in range(12):
        texts.append(" ".join(chain))
        chain = chain[12:] + own(12)
    crowd = own(60)
    for _ in range(100):
        copy = list(crowd)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(60)] = own(1)[0]
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    linked = [(a, b) for a in range(len(texts)) for b in range(max(0, a - 1 if a < 415 else 0), a) if jaccard(texts[a], texts[b]) >= 0.8]
    expected = {}
    for k, root in reach(list(range(len(texts))), linked).items():
        expected.setdefault(root, set()).add(k)
    assert groups_of(near_copies(docs).collect()) == {frozenset(g) for g in expected.values()} and 250 < len(expected) < 450


def shuffled(spark):
    """Bytes that this session's stages have written to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_texts_move_to_few_blocks(spark):
    """A crowd of which every pair has to be compared moves its texts a few times over, not once for each pair."""
    rng = random.Random(5)
    base, texts = [f"w{rng.randrange(10**9)}" for _ in range(1500)], []
    for _ in range(60):  # two copies lack 24 words each, so they have 0.73 of their shingles in common, and none is linked
        copy = list(base)
        for k in range(24):
            copy[60 * k + rng.randrange(50)] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = shuffled(spark)
        assert len({r.root for r in near_copies(docs, similarity=0.8).collect()}) == 60
        assert shuffled(spark) - before < 8 * sum(map(len, texts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_blocks_of_pairs(spark, monkeypatch):
    """A star, a clique and single pairs: each pair is in one block, and no block has many nodes."""
    monkeypatch.setattr(simhash_module, "BLOCK_TEXTS", 50)
    star, clique = [(0, k) for k in range(1, 1001)], [(a, b) for a in range(2000, 2100) for b in range(a + 1, 2100)]
    pairs = star + clique + [(k, k + 1) for k in range(5000, 6000, 2)]
    rows = [(bytearray(a.to_bytes(4)), bytearray(b.to_bytes(4))) for a, b in pairs]
    found = [(int.from_bytes(r.a), int.from_bytes(r.b), r.block) for r in simhash_module.dealt(spark.createDataFrame(rows, "a binary, b binary")).collect()]
    assert sorted((a, b) for a, b, _ in found) == sorted(pairs)
    nodes, blocks = {}, {}
    for a, b, block in found:
        nodes.setdefault(block, set()).update((a, b))
    for block, held in nodes.items():
        for k in held:
            blocks.setdefault(k, set()).add(block)
    assert max(map(len, nodes.values())) < 4 * 50 and sum(len(blocks[k]) for k in range(2000, 2100)) < len(clique) / 2


def test_links_across_blocks(spark, monkeypatch):
    """Repeated rows, null ids and a crowd that is cut into blocks: groups are those of brute force."""
    monkeypatch.setattr(simhash_module, "BLOCK_TEXTS", 5)
    rng = random.Random(6)
    crowd, texts = [f"c{rng.randrange(10**9)}" for _ in range(70)], []
    for _ in range(60):
        copy = list(crowd)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(70)] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(copy))
    rows = [(k, x) for k, x in enumerate(texts)] + [(3, texts[3]), (3, texts[4]), (None, texts[5]), (None, " ".join(crowd)), (None, None)]
    found = near_copies(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    expected = {}
    for k, root in reach(list(range(len(rows))), [(a, b) for a in range(len(rows)) for b in range(a) if jaccard(rows[a][1], rows[b][1]) >= 0.8]).items():
        expected.setdefault(root, []).append(repr(rows[k][0]))
    got = {}
    for r in found:
        got.setdefault(r.root, []).append(repr(r.doc_id))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values())) and len(expected) < len(rows) - 8
