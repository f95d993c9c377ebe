"""SimHash links and components against all pairs."""

import random
import re

import numpy as np
import xxhash
from ledgerlight.llm import common, simhash
from ledgerlight.llm.components import components, contracted

R = random.Random(3)
VOCABULARY = ["".join(R.choice("abcdefgh") for _ in range(R.randint(1, 6))) for _ in range(400)]


def words(n):
    return [R.choice(VOCABULARY) for _ in range(n)]


def edited(text, n):
    w = text.split(" ")
    for _ in range(n):
        w[R.randrange(len(w))] = R.choice(VOCABULARY)
    return " ".join(w)


def texts():
    out = [None, "", " \t\n", "one", "One", "two words", "é Ünï x\x85y z\xa0w", "a b c d"]
    for _ in range(12):
        base = " ".join(words(R.randint(30, 400)))
        out += [base, base.upper(), *(edited(base, R.randint(1, 4)) for _ in range(8))]
    return out + [" ".join(words(30)) for _ in range(80)] + [" ".join(words(30000))]


def plain_print(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, budget, ids):
    of = list(range(len(prints)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= budget:
                x, y = root(i), root(j)
                of[max(x, y)] = min(x, y)
    least = {}
    for i in range(len(prints)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least[root(i)] for i in range(len(prints))]


def test_near_duplicates(spark):
    all_texts = texts()
    ids = [1000 - i for i in range(len(all_texts))]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in zip(ids, all_texts, strict=True)], "doc_id long, text string, f0 int, key string").repartition(3)
    prints = [plain_print(t, 4) for t in all_texts]
    want = dict(zip(ids, plain_components(prints, 4, ids), strict=True))
    assert len(set(want.values())) < len(set(prints)) < len(ids)
    for lane_rows in (simhash.LANE_ROWS, 3):
        got = {r.doc_id: r for r in simhash.near_duplicates(docs, lane_rows=lane_rows).collect()}
        assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in zip(ids, prints, strict=True)}
        assert {i: r.component_id for i, r in got.items()} == want
    twice = simhash.near_duplicates(docs.union(docs).union(docs.limit(1).selectExpr("CAST(NULL AS long)", "text", "f0", "key")))
    assert twice.count() == 2 * len(ids) + 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_trie_join_links_all_within_the_budget():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 64, 20, dtype="u8")
    flips = (np.uint64(1) << rng.integers(0, 64, (600, 5), dtype="u8")).astype("u8")
    words = np.sort(centres[rng.integers(0, 20, 600)] ^ np.bitwise_xor.reduce(flips, 1))[:, None]
    forest = simhash.Forest(600)
    simhash.trie_join(words, [(0, 600, 0, 600)], 4, forest)
    near = np.bitwise_count(words ^ words.T) <= 4
    reach = near.copy()
    for _ in range(10):
        reach = (reach.astype("i4") @ reach.astype("i4")) > 0
    assert ((forest.of[:, None] == forest.of[None, :]) == reach).all()


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(500, 500 + i) for i in range(1, 50)] + [(900, 901), (901, 900), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(500, 550), 500), 900: 900, 901: 900}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rising_chain_takes_few_rounds(spark):
    rest = spark.createDataFrame([(i, i + 1) for i in range(2000)], "a long, b long").selectExpr("xxhash64(a) AS a", "xxhash64(b) AS b")
    rest = rest.selectExpr("least(a, b) AS a", "greatest(a, b) AS b")
    rounds = 0
    while not rest.isEmpty():
        rest, rounds = contracted(rest)[1], rounds + 1
    assert rounds <= 15


def test_frequent_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_ROWS", 20)
    rows = spark.createDataFrame([(i, 7 if i % 2 else i) for i in range(200)] + [(500 + i, None) for i in range(30)], "node long, to long")
    one = spark.createDataFrame([(i, -i) for i in range(0, 100)], "to long, next long")
    plan = common.spread_join(rows, one, "to", "node")
    assert "_lane" in plan._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, plan.select("node", "next").collect()), key=str) == sorted(map(tuple, rows.join(one, "to", "left").select("node", "next").collect()), key=str)
    pairs = spark.createDataFrame([(5, 5 + i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(0, 40, 2)], "a long, b long")
    got = {r.node: r.root for r in components(pairs).collect()}
    assert got == {**dict.fromkeys(range(5, 305), 5), **{1000 + i: 1000 + i - i % 2 for i in range(40)}}


def test_keys_follow_the_number_of_nodes(spark):
    """More nodes give keys of more bits, not more copies of a row for each lane; pairs within the budget share one."""
    few, many, most = (simhash.block_keys(4, n) for n in (10_000, 10**9, 10**12))
    assert (len(few), len(many), len(most)) == (5, 15, 70)
    rng = np.random.default_rng(9)
    left = rng.integers(0, 1 << 64, 300, dtype="u8")
    right = left ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, 4), dtype="u8"), 1)
    for keys in (few, many, most):
        asked = [spark.createDataFrame(list(enumerate(x.view("i8").tolist())), "i long, f0 long").select("i", simhash.F.array(*keys).alias("k")).collect() for x in (left, right)]
        assert all(set(a.k) & set(b.k) for a, b in zip(sorted(asked[0]), sorted(asked[1]), strict=True))


def test_rows_of_one_doc_id_with_different_texts_stay(spark):
    a, b = " ".join(words(60)), " ".join(words(60))
    rows = [(1, a, "x", 1), (1, b, "y", 2), (1, a, "x", 3), (2, a + " z", "z", 4), (3, None, None, 5), (3, "", None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, node long")
    got = sorted((r.doc_id, r.text or "") for r in simhash.keep_one_of_each(docs).collect())
    assert got == sorted([(1, a), (1, b), (3, "")])


def test_similar_documents(spark):
    base = [" ".join(words(300)) for _ in range(30)]
    rows = [(i, b) for i, b in enumerate(base)] + [(100 + i, edited(b, 2)) for i, b in enumerate(base)] + [(200 + i, b) for i, b in enumerate(base)]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, node string")
    kept = {r.doc_id for r in simhash.keep_one_of_each(docs).collect()}
    assert set(range(30)) <= kept and len(kept) <= 32
    extra = docs.union(docs.limit(3)).unionByName(spark.createDataFrame([(None, "x", "q"), (300, None, None), (301, "", None)], docs.schema))
    out = simhash.keep_one_of_each(extra)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(kept) + 2 and None in ids and 300 in ids
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0


def plain_kept(docs, bound=0.8):
    """doc_ids that stay, from all pairs of sets of five-word shingles."""
    sets = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(max(1, len(w) - 4))} for i, t in docs}
    of = {i: i for i in sets}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) + 1e-9 >= bound * len(sets[i] | sets[j]):
                x, y = root(i), root(j)
                of[max(x, y)] = min(x, y)
    return {i for i in sets if root(i) == i}


def kept_of(spark, docs):
    return {r.doc_id for r in simhash.keep_one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def pairs_of_similarity(rng, shared, each):
    """Two texts with ``shared`` words in common and ``each`` of their own at the end, none twice."""
    word = lambda: "w%x" % rng.getrandbits(60)
    base = [word() for _ in range(shared)]
    return [" ".join([*base, *(word() for _ in range(each))]) for _ in range(2)]


def test_similar_documents_on_both_sides_of_the_bound(spark):
    rng = random.Random(11)
    docs = []
    for k, own in enumerate([4, 6, 8, 10, 11, 12, 13, 14, 15, 16, 18, 20, 24] * 6):
        docs += [(2 * k + i, t) for i, t in enumerate(pairs_of_similarity(rng, 100, own))]
    want = plain_kept(docs)
    assert len(docs) / 2 < len(want) < len(docs)
    assert kept_of(spark, docs) == want


def test_no_similar_pair_is_lost(spark):
    rng = random.Random(12)
    docs = []
    for k in range(80):  # 80 of 100 and 160 of 200 shingles in common
        docs += [(2 * k + i, t) for i, t in enumerate(pairs_of_similarity(rng, *((84, 10), (164, 20))[k % 2]))]
    for k in range(80, 160):  # four shingles, and one more
        long = " ".join("w%x" % rng.getrandbits(60) for _ in range(9))
        docs += [(2 * k, long.rsplit(" ", 1)[0]), (2 * k + 1, long)]
    assert plain_kept(docs) == set(range(0, 320, 2))
    assert kept_of(spark, docs) == set(range(0, 320, 2))


def test_pairs_of_a_large_group_stay_in_their_tasks(spark):
    """Texts that share a passage but stay apart: the few similar ones are linked, and no join makes their pairs."""
    rng = random.Random(16)
    word = lambda: "w%x" % rng.getrandbits(60)
    passage = [word() for _ in range(75)]
    docs = [(k, " ".join([*passage, *(word() for _ in range(12))])) for k in range(90)]
    for k in range(0, 90, 9):  # the last words of some are those of another
        own = docs[k][1].split(" ")
        docs.append((200 + k, " ".join([*own[:84], *(word() for _ in range(3))])))
    want = plain_kept(docs)
    assert want == set(range(90))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for lane_rows in (simhash.LANE_ROWS, 16):
        assert {r.doc_id for r in simhash.keep_one_of_each(frame, lane_rows=lane_rows, budget=0).collect()} == want


def test_bands_alone_find_all_similar_pairs(spark, tmp_path):
    rng = random.Random(18)
    docs = []
    for k, own in enumerate([2, 6, 10, 11, 12, 13, 16, 24] * 8):
        docs += [(2 * k + i, t) for i, t in enumerate(pairs_of_similarity(rng, 100, own))]
    base = [f"b{i}" for i in range(100)]
    for k in range(40):  # a group of which some are near each other
        own = list(base)
        for at in rng.sample(range(100), rng.choice([1, 2, 3])):
            own[at] = "w%x" % rng.getrandbits(60)
        docs.append((1000 + k, " ".join(own)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    prints = simhash.sketches(frame, 5, 40, 5).cache()
    node_of = {r.doc_id: r.node for r in prints.collect()}
    rows = prints.select("node", "n", simhash.F.posexplode("keys").alias("band", "key")).distinct().withColumn("root", simhash.F.col("node"))
    files = simhash.SetFiles(f"file://{tmp_path}", 3, 40, 5)
    files.write(simhash.shingle_sets(frame, 5, prints.select("node")))
    for lane_rows in (simhash.LANE_ROWS, 7):
        found = {(r.a, r.b) for r in simhash.similar_in_bands(rows, files, 0.8, lane_rows).collect()}
        sets = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for i, t in docs}
        pairs = {(node_of[i], node_of[j]) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) + 1e-9 >= 0.8 * len(sets[i] | sets[j])}
        assert parted(found, node_of.values()) == parted(pairs, node_of.values())


def parted(pairs, nodes):
    """The nodes in their components."""
    of = {n: n for n in nodes}

    def root(n):
        while of[n] != n:
            n = of[n]
        return n

    for a, b in pairs:
        of[root(a)] = root(b)
    groups = {}
    for n in of:
        groups.setdefault(root(n), set()).add(n)
    return {frozenset(g) for g in groups.values()}


def test_set_files_give_back_what_was_written(spark, tmp_path):
    rng = np.random.default_rng(4)
    sets = {int(k): np.unique(rng.integers(0, 1 << 64, int(rng.integers(1, 400)), dtype="u8")) for k in rng.integers(-(1 << 62), 1 << 62, 50)}
    files = simhash.SetFiles(f"file://{tmp_path}", 3, 40, 5)
    frame = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in sets.items()], "node long, shingles binary")
    files.write(frame.repartition(5))
    asked = frame.selectExpr("node", "CAST(pmod(xxhash64(node), 3) AS int) AS shard").collect()
    keys, marks, members = files.reader()(np.array([r.node for r in asked]), np.array([r.shard for r in asked]))
    for i, r in enumerate(asked):
        least = simhash.least_values(sets[r.node], *simhash.random_functions(40, 5))
        assert (members(i) == sets[r.node]).all() and (keys[i] == simhash.band_keys(least)).all() and (marks[i] == least.astype("u1").ravel()).all()


def test_repeated_shingles_count_once(spark):
    rng = random.Random(13)
    text = lambda n: " ".join("w%x" % rng.getrandbits(60) for _ in range(n))
    docs = []
    for k in range(0, 60, 2):
        once, passage = text(120), text(8)
        docs += [(k, once), (k + 1, f"{once} {once}"), *((100 + k + i, " ".join([passage] * 60 + [text(150)])) for i in range(2))]
    assert plain_kept(docs) == {*range(0, 60, 2), *range(100, 160)}
    assert kept_of(spark, docs) == {*range(0, 60, 2), *range(100, 160)}


def test_chains_and_large_groups(spark):
    rng = random.Random(14)
    word = lambda: "w%x" % rng.getrandbits(60)
    base = [word() for _ in range(120)]
    docs = [(1000, " ".join(base))]
    for k in range(60):  # each near the base, few near each other
        own = list(base)
        for at in rng.sample(range(120), 2):
            own[at] = word()
        docs.append((k, " ".join(own)))
    want = plain_kept(docs)
    assert want == {0} and kept_of(spark, docs) == want
