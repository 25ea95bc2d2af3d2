"""SimHash classes and decontamination against brute force."""

import random

import numpy as np
import pyarrow as pa
import xxhash
from compare import compare, duck

from wardspark.llm import common, decontam, lex, near_dups, simhash

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def plain_fingerprint(text, n=4):
    w = common.words_of(text)
    grams = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(grams))


def plain_classes(fps, bits=4):
    """Root of each item, the first of its class, over all pairs."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(fps))]


def _want(rows):
    fps = [plain_fingerprint(t or "") for _, t in rows]
    roots = plain_classes(fps)
    least = {}
    for r, (i, _) in zip(roots, rows, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, roots, strict=True)), key=repr)


def test_simhash(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()]
    assert sorted(map(tuple, simhash.op8_simhash(spark, SF).collect()), key=repr) == _want(rows)
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = [(r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in simhash.classes(odd_docs).collect()]
    assert sorted(got, key=repr) == _want(odd)
    assert simhash.classes(no_docs).count() == 0
    assert simhash.keep_one(odd_docs).columns == odd_docs.columns


def test_simhash_equals_sql(spark):
    got, want = compare(spark, duck(SF), SF, simhash.op8_simhash, simhash.SQL)
    assert got == want


def test_copies_and_hubs(spark):
    """A text that a third of all rows share and a class of many fingerprints around one are joined by broadcast; nothing else changes."""
    rows = [(i, "one text that many rows have") for i in range(0, 900, 3)] + [(i, f"text number {i} of its own words w{i}") for i in range(900) if i % 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in simhash.classes(docs).collect()), key=repr)
    assert got == _want(rows)
    star = spark.createDataFrame([(k, 0) for k in range(1, 500)] + [(k + 1000, k) for k in range(1, 500, 7)] + [(5000, 4999)], "u long, v long")
    found = {r.node: r.root for r in simhash.components(star, common.work_dir(spark, "t")).collect()}
    assert found == {**dict.fromkeys(range(500), 0), **dict.fromkeys(range(1001, 1500, 7), 0), 4999: 4999, 5000: 4999}


def test_keys_meet_within_four_bits():
    rng = random.Random(1)
    for _ in range(1500):
        x = y = rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        key, at, side = simhash.keys_of(np.array([x, y], np.uint64).view(np.int64))
        one = [set(key[(at == i) & ((side & 1) > 0)]) for i in (0, 1)]
        many = [set(key[(at == i) & ((side & 2) > 0)]) for i in (0, 1)]
        assert one[0] & many[1] and one[1] & many[0]


def test_dense_cluster_and_chain(spark):
    """A large group of near fingerprints, and a long chain, stay whole; every group path is used."""
    rng, fps = random.Random(2), []
    base = rng.getrandbits(64)
    for _ in range(900):
        x = base
        for b in rng.sample(range(64), rng.randint(0, 3)):
            x ^= 1 << b
        fps.append(x)
    chain = rng.getrandbits(64)
    for i in range(30):
        chain ^= 0b111 << (2 * i)
        fps.append(chain)
    fps += [rng.getrandbits(64) for _ in range(300)]
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(nodes), common.work_dir(spark, "t")).collect()}
    roots = plain_classes(fps)
    groups = {}
    for f, r in zip(signed, roots, strict=True):
        groups.setdefault(r, set()).add(found.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)
    links = list(simhash.forest(np.array(signed), 4))
    assert sum(len(a) for a, _ in links) == len(fps) - len(groups)


def _brute(texts, items):
    out = []
    for t in texts:
        h = items.term(lex.Words([t or ""]).hash).tolist()
        bad = False
        for x in items.terms:
            n, k = len(x), min(decontam.ANSWER, len(x))
            for s in range(0, max(1, len(h)), decontam.BLOCK):
                region = h[max(0, s - n) : s + 2 * decontam.BLOCK + n]
                share = decontam.lcs(decontam.masks_of(x), n, region) / n
                answer = decontam.lcs(decontam.masks_of(x[-decontam.ANSWER :]), k, region) / k
                bad |= share >= decontam.LCS or (share >= decontam.PARAPHRASE and answer >= decontam.ANSWER_SHARE)
        out.append(bad)
    return out


def test_decontamination(spark, odd_docs, no_docs):
    docs, bench = common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark")
    items = decontam.Items(sorted(bench.collect(), key=lambda r: r.item_id))
    got = {r.doc_id: r.contaminated for r in decontam.op6_decontam(spark, SF).collect()}
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], _brute([r.text for r in rows], items), strict=True))
    assert got == want and any(want.values()) and not all(want.values())
    assert not any(r.contaminated for r in decontam.judged(odd_docs, bench).collect())
    assert decontam.judged(odd_docs, bench).count() == odd_docs.count()
    assert decontam.judged(no_docs, bench).count() == 0
    assert decontam.judged(odd_docs, bench.limit(0)).filter("not contaminated").count() == odd_docs.count()
    assert decontam.keep_clean(docs, bench).count() == sum(not x for x in want.values())


def test_benchmark_in_parts(spark):
    """A benchmark of more items than go to a task at once gives the same verdicts."""
    docs, bench = common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark")
    whole = sorted((r.doc_id, r.contaminated) for r in decontam.judged(docs, bench).collect())
    most = bench.count() // 3 + 1
    assert sorted((r.doc_id, r.contaminated) for r in decontam.judged(docs, bench, most).collect()) == whole and any(x for _, x in whole)


def test_paraphrase_is_found(spark):
    """An item with words dropped and words put in is still found; a shuffled one is not."""
    rng = random.Random(4)
    docs, bench = common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark")
    item = max(bench.collect(), key=lambda r: len(r.text.split()))
    w = item.text.split()
    changed = [x for i, x in enumerate(w) if i % 9 != 4]
    for at in (5, 12, 20):
        changed.insert(at, "zzz")
    mixed = w[:]
    rng.shuffle(mixed)
    extra = spark.createDataFrame([(10**6, " ".join(["pad"] * 50 + changed + ["pad"] * 70)), (10**6 + 1, " ".join(mixed))], "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.judged(docs.select("doc_id", "text").union(extra), bench).collect()}
    assert got[10**6].contaminated and got[10**6].item_id == item.item_id
    assert not got[10**6 + 1].contaminated


def test_wide_leaks_are_found(spark):
    """A passage that stands in a third of all rows, and one in three documents of a tiny table, whose words all are frequent by it."""
    docs, bench = common.table(spark, SF, "documents").select("doc_id", "text"), common.table(spark, SF, "benchmark")
    item = max(bench.collect(), key=lambda r: len(r.text.split()))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    spread = [(i, f"{t} {item.text} {t}" if n % 3 == 0 else t) for n, (i, t) in enumerate(rows)]
    copies = rows + [(10**6 + n, item.text) for n in range(len(rows) // 2)]
    tiny = [(n, f"one two three four {item.text} five six") for n in range(3)] + [(3, "another text of a few words"), (4, None)]
    items = decontam.Items(sorted(bench.collect(), key=lambda r: r.item_id))
    for some, sure in ((spread, {i for n, (i, _) in enumerate(rows) if n % 3 == 0}), (copies, {i for i, _ in copies if i >= 10**6}), (tiny, {0, 1, 2})):
        bad = {r.doc_id for r in decontam.judged(spark.createDataFrame(some, "doc_id long, text string"), bench).filter("contaminated").collect()}
        assert sure <= bad and bad == {i for (i, _), b in zip(some, _brute([t for _, t in some], items), strict=True) if b}


def test_lcs():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontam.lcs(decontam.masks_of(np.array(a)), len(a), b) == table[-1][-1]


def test_wide_classes(spark, odd_docs, no_docs):
    """Classes of similarity 0.8 on a whole table: exactly those of all pairs of shingle sets."""
    rows = [(r.doc_id, r.text) for r in common.table(spark, SF01, "documents").collect()]
    got = {r.doc_id: r.component_id for r in near_dups.classes(common.table(spark, SF01, "documents")).collect()}
    assert got == _similar_classes(rows) and len(set(got.values())) < len(got)
    odd = near_dups.classes(odd_docs)
    assert odd.count() == odd_docs.count() and near_dups.classes(no_docs).count() == 0
    assert {r.component_id for r in odd.filter("doc_id in (0, 1, 2)").collect()} == {0}


def test_candidates_reach_the_threshold():
    """Of pairs at 0.8 and just above, at least 0.98 share an index and are within reach, whatever their length and shape."""
    rng = np.random.default_rng(3)
    new = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    for n in (25, 40, 100, 400, 1500):
        for share in (0.8, 0.825, 0.85):
            own = int(n * (1 - share) / (1 + share) + 1e-9)
            pairs = []
            for _ in range(100):
                a, common_part = new(n), new(n - own)
                pairs += [(a, a[: int(np.ceil(share * n - 1e-9))]), (np.concatenate([common_part, new(own)]), np.concatenate([common_part, new(own)]))]
            a, b = near_dups.wide_of([x for x, _ in pairs]), near_dups.wide_of([y for _, y in pairs])
            met = (near_dups.indices_of(a) == near_dups.indices_of(b)).any(1) & (np.bitwise_count(a ^ b).sum(1, dtype=int) <= near_dups.REACH)
            assert met.mean() >= 0.98


def test_wide_forest_and_pairs_agree():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (3, 8)).astype(np.uint64)
    noise = np.packbits(rng.random((600, 512)) < 0.06, axis=1, bitorder="little").view(np.uint64).reshape(-1, 8)
    wide = base[rng.integers(0, 3, 600)] ^ noise
    links = [p for a, b in near_dups.forest(wide, 86) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(links) == 597
    small = wide[:200]
    pairs = {p for a, b in near_dups.pairs_within(np.zeros(200, np.int32), small, 86) for p in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(a, b) for b in range(200) for a in range(b) if np.bitwise_count(small[a] ^ small[b]).sum(dtype=int) <= 86}
    assert pairs == want


def _similar_classes(rows):
    """Class of each (id, text): the least id of what pairs of Jaccard similarity 0.8 or more connect."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (common.words_of(t) for _, t in rows)]
    least = {i: i for i, _ in rows}
    changed = True
    sizes = [len(x) for x in sets]
    close = lambda a, b: 5 * min(sizes[a], sizes[b]) >= 4 * max(sizes[a], sizes[b])
    pairs = [(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a) if close(a, b) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return least


def test_repeated_lines_do_not_decide(spark):
    """One line repeated in two different texts joins nothing; the same text with a line once and five times is one class."""
    rng = random.Random(6)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    line, body = words(20), words(200)
    rows = [(i, f"{words(100)} " + f"{line} " * 8) for i in range(6)] + [(10, f"{body} {line}"), (11, f"{body} " + f"{line} " * 5)]
    got = {r.doc_id: r.component_id for r in near_dups.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _similar_classes(rows) and len(set(got.values())) == 7


def test_large_groups_in_blocks(spark):
    """A group cut into many blocks has the classes of all pairs: around one text, in a chain, and of two kinds that only candidates connect."""
    rng = random.Random(13)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, rows = words(60), []
    for _ in range(80):  # around one text
        w = base[:]
        w[rng.randrange(60)] = "other"
        rows.append(w)
    chain = words(60)
    for _ in range(40):  # each like the one before only
        chain = chain[3:] + words(3)
        rows.append(chain)
    half = words(40)
    rows += [half + words(20) for _ in range(30)] + [base[:45] + words(15) for _ in range(30)]
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(900, rows and " ".join(rows[0])), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _similar_classes(rows)
    assert len(set(want.values())) < len(rows) / 2
    for most, crowd in ((near_dups.BLOCK, near_dups.CROWD), (6000, near_dups.CROWD), (1500, 20)):
        got = {r.doc_id: r.component_id for r in near_dups.classes(docs, 200, most, crowd).collect()}  # 200 bits: far more candidates than links
        assert got == want


def test_crowds_stream_by():
    """Groups beyond the limit come out as stars, whole and apart, wherever batches end."""
    rng = np.random.default_rng(6)
    keys = np.sort(np.concatenate([np.full(500, 3), np.full(400, 7), rng.integers(0, 12, 60)]).astype(np.int32))
    nodes, wide = np.arange(len(keys)), rng.integers(0, 2**63, (len(keys), 8)).astype(np.uint64)
    for size in (1, 7, 50, 2000):
        batches = [pa.record_batch([pa.array(keys[k : k + size]), pa.array(nodes[k : k + size]), pa.array([x.tobytes() for x in wide[k : k + size]], pa.binary())], names=["key", "node", "wide"]) for k in range(0, len(keys), size)]
        made = [b for b in near_dups._links(0, 100)(iter(batches))]
        of = {}
        for b in made:
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
                assert keys[u] == keys[v] in (3, 7)
                of.setdefault(int(keys[u]), {v})
                of[int(keys[u])].add(u)
        if size < 2000:  # a batch that holds a group whole is compared instead
            assert {k: len(x) for k, x in of.items()} == {k: int((keys == k).sum()) for k in (3, 7)}


def test_similarity_decides_at_the_threshold(spark):
    """Pairs of 0.8 and just above are joined and those just below are not, short texts included."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for n in [8, 9, 10, 11, 16, 19, 20, 24, 29, 30, 60, 104, 204, 404] * 6:
        w = words(n)
        size = n - 4
        for cut in (size // 5, size // 5 + 1, size // 6):
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[: n - cut]))]
            w = words(n)
    got = {r.doc_id: r.component_id for r in near_dups.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = _similar_classes(rows)
    assert all(got[i] >= want[i] for i in got)  # nothing below 0.8 is joined
    short = {i for i, t in rows if len(t.split()) <= near_dups.SHORT + 4}
    assert all(got[i] == want[i] for i in short if i ^ 1 in short)
    assert sum(got[i] != want[i] for i in got) <= 0.02 * len(got)
