"""Copies, near copies, lines, mixing and packing, against plain code."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lakewarden.llm import components, exact_dedup, fingerprints, line_dedup, mixing, packing, queries, simhash

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]")


def key(row):
    return tuple((v is not None, str(v)) for v in row)


def roots(nodes, links):
    of = {n: n for n in nodes}

    def top(n):
        while of[n] != n:
            of[n] = of[of[n]]
            n = of[n]
        return n
    for a, b in links:
        x, y = top(a), top(b)
        of[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_exact_copies_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    got = queries.op3_exact_dedup(spark, SF)
    want = con.execute(f"select {', '.join(got.columns)} from ({exact_dedup.SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_exact_copies_of_rough_rows(rough, texts):
    groups = defaultdict(list)
    for i, t in texts(rough):
        groups[SPACE.sub("", t)].append((i, len(t)))
    want = []
    for bare, rows in groups.items():
        named = [(-n, i) for i, n in rows if i is not None]
        keep = min(named)[1] if named else None
        best = -min(named)[0] if named else None
        want += [(i, keep if len(rows) > 1 else i, len(rows), len(rows) == 1 or keep is None or (i == keep and n == best),
                  sha256(bare.encode()).hexdigest()) for i, n in rows]
    got = exact_dedup.exact_duplicates(rough)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    kept = exact_dedup.drop_exact_duplicates(rough)
    assert kept.columns == rough.columns and kept.count() == sum(r[3] for r in want)
    assert exact_dedup.exact_duplicates(rough.limit(0)).count() == 0


def plain_simhash(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = [w for w in SPACE.split(words) if w]
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(spark, rough, texts, documents):
    for docs in (documents, rough.filter(F.length("text") < 10_000), rough.limit(0)):
        rows = texts(docs)
        prints = [plain_simhash(t) for _, t in rows]
        links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
        of = roots(range(len(rows)), links)
        least = defaultdict(list)
        for n, (i, _) in enumerate(rows):
            least[of[n]] += [] if i is None else [i]
        want = [(i, f"{p:016x}", min(least[of[n]], default=None)) for n, ((i, _), p) in enumerate(zip(rows, prints))]
        got = simhash.near_duplicates(docs).collect()
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def near_cluster(seed, n, centres, flips):
    random = np.random.default_rng(seed)
    centre = random.integers(0, 2 ** 63, centres).astype(np.uint64)
    out = centre[random.integers(0, centres, n)]
    for _ in range(flips):
        out = out ^ (np.uint64(1) << random.integers(0, 64, n).astype(np.uint64))
    return np.unique(out)


@pytest.mark.parametrize("seed, n, centres, flips", [(1, 400, 3, 2), (2, 600, 40, 3), (3, 500, 1, 1), (4, 300, 300, 0), (5, 400, 2, 6)])
def test_trie_join_against_all_pairs(seed, n, centres, flips):
    prints = near_cluster(seed, n, centres, flips)
    group = np.arange(len(prints)) * 2 // len(prints)
    a, b = simhash.links_within(group, prints, piece=500)
    found = roots(range(len(prints)), zip(a.tolist(), b.tolist()))
    bits = [int(p) for p in prints]
    links = [(x, y) for x in range(len(bits)) for y in range(x) if group[x] == group[y] and (bits[x] ^ bits[y]).bit_count() <= 3]
    assert found == roots(range(len(prints)), links)


def test_large_groups_split_without_losing_links(spark):
    prints = np.unique(np.concatenate([near_cluster(7, 500, 1, 3), near_cluster(8, 300, 60, 2)])).view(np.int64)
    df = spark.createDataFrame([(int(p),) for p in prints], "print long")
    bits = [int(p) & (2 ** 64 - 1) for p in prints]
    links = [(x, y) for x in range(len(bits)) for y in range(x) if (bits[x] ^ bits[y]).bit_count() <= 3]
    want = roots(range(len(bits)), links)
    for limit in (30, 10_000):
        at = {int(p): n for n, p in enumerate(prints)}
        got = [(at[r["u"]], at[r["v"]]) for r in simhash.near_links(df, limit).collect()]
        assert roots(range(len(bits)), got) == want


def test_components(spark):
    random = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200)]
    edges += [(int(a), int(b)) for a, b in random.integers(1000, 1200, (150, 2))]
    edges = [edges[i] for i in random.permutation(len(edges))]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert got == roots(nodes, [e for e in edges if e[0] != e[1]])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_shingles(text):
    words = [w for w in SPACE.split(re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_neighbours(spark, documents, rough, texts):
    for docs in (documents, rough, rough.filter("doc_id = 1"), rough.limit(0)):
        rows = sorted(texts(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        got = sorted(fingerprints.neighbour_likeness(docs).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        assert len(got) == len(rows)
        off = []
        for k, ((i, t), r) in enumerate(zip(rows, got)):
            following = rows[(k + 1) % len(rows)][1]
            m = len(t) // 4
            new = t[:len(t) - m] + following[:m]
            assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i, len(t), sha256(new.encode()).hexdigest())
            for near, other in ((r["near_edited"], new), (r["near_next"], following)):
                a, b = plain_shingles(t), plain_shingles(other)
                off.append(abs(near - (len(a & b) / len(a | b) if a | b else 1)))
        assert not off or (max(off) < 0.25 and np.mean(off) < 0.05)
    alike = {}
    for r in fingerprints.neighbour_likeness(rough).collect():
        alike.setdefault(r["doc_id"], set()).add(bytes(r["fingerprint"]))
    assert alike[1] == alike[5] == alike[6] and alike[2] == alike[3] == alike[4] and len(alike[9]) == 1
    one = {r["doc_id"]: bytes(r["fingerprint"]) for r in fingerprints.fingerprints(documents).collect()}
    assert one == {r["doc_id"]: bytes(r["fingerprint"]) for r in fingerprints.neighbour_likeness(documents).collect()}


def plain_dropped(rows):
    """Doc and line of recurring lines, by the same rules in plain code."""
    lines = []
    for i, t in rows:
        for n, line in enumerate(t.split("\n")):
            words = ["<*>" if re.search("[0-9]", w) else w for w in SPACE.split(line) if w]
            if len(words) >= 5 and i is not None:
                width = max(1, -(-(len(words) - 3) // 4))
                runs = [tuple(words[3 + k * width:3 + (k + 1) * width]) for k in range(4)]
                lines.append((i, n, (len(words), *words[:3]), [(k, r) for k, r in enumerate(runs) if r]))
    docs = defaultdict(set)
    for i, _, leaf, runs in lines:
        for r in runs:
            docs[leaf, r].add(i)
    held = defaultdict(set)
    parsed = []
    for i, n, leaf, runs in lines:
        fixed = tuple(r for r in runs if len(docs[leaf, r]) > 1)
        if fixed and sum(len(r) for _, r in fixed) + 3 >= 0.6 * leaf[0]:
            held[leaf, fixed].add(i)
            parsed.append((i, n, (leaf, fixed)))
    return {(i, n) for i, n, t in parsed if len(held[t]) >= 3 and i != min(held[t])}


def test_recurring_lines(spark, documents, rough, texts):
    made = spark.createDataFrame([
        (k, f"Prose number one stands here alone {'abcdefghij'[k]} and more of it follows now\n"
            f"Posted by user{k} on the board at {k}:30 under a permissive license text\nshort line") for k in range(6)],
        "doc_id long, text string")
    for docs in (documents, made, rough, rough.limit(0)):
        want = plain_dropped(texts(docs))
        got = {tuple(r) for r in line_dedup.recurring_lines(docs).collect()}
        assert got == want
        left = line_dedup.drop_recurring_lines(docs)
        assert left.columns == [*docs.columns, "dropped_lines"] and left.count() == docs.count()
        for r, t in ((r, dict(texts(docs))) for r in left.filter("doc_id <> 9").collect()):
            lines = t[r["doc_id"]].split("\n")
            assert (r["text"] or "") == "\n".join(x for n, x in enumerate(lines) if (r["doc_id"], n) not in want)
    assert {tuple(r) for r in line_dedup.recurring_lines(made).collect()} >= {(k, 1) for k in range(1, 6)}


def plain_targets(sizes):
    weights, total = [k % 3 + 1 for k in range(len(sizes))], sum(sizes)
    out, fixed = [0.0] * len(sizes), set()
    while True:
        rest = total - sum(out[k] for k in fixed)
        among = sum(w for k, w in enumerate(weights) if k not in fixed)
        for k, w in enumerate(weights):
            if k not in fixed:
                out[k] = rest * w / among
        above = {k for k in range(len(sizes)) if k not in fixed and out[k] > 3 * sizes[k]}
        if not above:
            return out
        for k in above:
            out[k] = 3.0 * sizes[k]
        fixed |= above


def test_mix(spark, documents, rough):
    for docs, block in ((documents, 1024), (documents, 37), (rough, 100)):
        rows = docs.select("doc_id", "text", "source").collect()
        size = [len([w for w in SPACE.split(r["text"] or "") if w]) for r in rows]
        total = defaultdict(int)
        for r, n in zip(rows, size):
            total[r["source"]] += n
        order = sorted(total, key=lambda s: (s is None, s or ""))
        goal = dict(zip(order, plain_targets([total[s] for s in order])))
        got = mixing.mix(docs, block=block, per_bucket=20).collect()
        assert Counter((r["doc_id"], r["source"], r["size"], r["source_size"]) for r in got) == Counter(
            (r["doc_id"], r["source"], n, total[r["source"]]) for r, n in zip(rows, size))
        taken = defaultdict(int)
        partly = Counter()
        for r in got:
            assert r["target"] == pytest.approx(goal[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source"]] += r["taken"]
            partly[r["source"]] += bool(r["size"] and r["taken"] % r["size"])
        for s in order:
            assert abs(taken[s] - goal[s]) <= 0.5 and partly[s] <= 1
        again = mixing.mix(docs.repartition(7), block=block, per_bucket=20).collect()
        assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.mix(rough.limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix(rough.filter("doc_id in (2, 3, 4)")).collect()} == {0}


def test_schedule_is_in_proportion(spark):
    sources = [{"number": 0, "source_size": 90_000, "target": 10_000.0}, {"number": 1, "source_size": 9_000, "target": 20_000.0},
               {"number": 2, "source_size": 70_000, "target": 70_000.0}]
    slots = sorted(mixing.schedule(spark, sources, 10, 3.0).collect(), key=lambda r: r["slot"])
    assert len({r["slot"] for r in slots}) == len(slots)
    for number, goal in ((0, 0.1), (1, 0.2), (2, 0.7)):
        assert sum(r["words"] for r in slots if r["number"] == number) == sources[number]["target"]
        for n in (100, 1000, 5000):
            assert abs(sum(r["number"] == number for r in slots[:n]) - goal * n) <= 4
        assert [r["rank"] for r in slots if r["number"] == number] == list(range(sum(r["number"] == number for r in slots)))


def test_mixed_documents(documents, rough):
    for docs in (documents, rough):
        taken = Counter()
        sizes = Counter()
        for r in mixing.mix(docs).collect():
            taken[r["doc_id"]] += r["taken"]
            sizes[r["doc_id"]] += r["size"]
        out = mixing.mixed_documents(docs)
        assert out.columns == docs.columns
        got = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        times = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        assert got == {i: -(-taken[i] // sizes[i]) * times[i] for i in taken if taken[i]}


def test_best_fit_alone():
    placed, bins = packing.best_fit([600, 500, 400, 100, 30], (512, 1024))
    held = defaultdict(list)
    for size, (number, offset) in zip([600, 500, 400, 100, 30], placed):
        held[number].append((offset, size))
    for number, items in held.items():
        items.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(items, items[1:]))
        assert sum(items[-1]) <= bins[number]
    assert packing.best_fit([], (512,)) == ([], [])
    assert packing.best_fit([10], (512, 1024))[1] == [512]
    assert len(packing.best_fit([512] * 8, (512, 4096))[1]) == 1


def packed_cost(bins):
    return sum(map(packing.sequence_cost, bins))


def single_cost(sizes, opened):
    table = tuple(max(opened, own) for own in packing.LENGTHS)
    used = packing._filled(sorted(sizes, reverse=True), list(packing.LENGTHS), table)[1]
    return packed_cost(min(x for x in packing.LENGTHS if x >= u) for u in used)


def cheapest_packing(sizes):
    """The least cost of all partitions into bins."""
    best = [float("inf")]

    def place(k, sums):
        if k == len(sizes):
            best[0] = min(best[0], packed_cost(min(x for x in packing.LENGTHS if x >= u) for u in sums))
            return
        for j in range(len(sums)):
            if sums[j] + sizes[k] <= max(packing.LENGTHS):
                place(k + 1, [*sums[:j], sums[j] + sizes[k], *sums[j + 1:]])
        place(k + 1, [*sums, sizes[k]])

    place(0, [])
    return best[0]


def test_lengths_are_chosen_jointly():
    draw = random.Random(4)
    inputs = [[draw.randint(1, top) for _ in range(400)] for top in (100, 600, 1500, 4096)] + [
        [draw.randint(500, 520) for _ in range(2000)], [draw.choice([300, 700, 1300, 2500]) for _ in range(500)]]
    below = []
    for sizes in inputs:
        ours, singles = packed_cost(packing.best_fit(sizes)[1]), [single_cost(sizes, x) for x in packing.LENGTHS]
        assert ours <= min(singles)
        below.append(ours < min(singles))
    assert below[4]
    ratios = []
    for _ in range(60):
        sizes = [draw.choice([draw.randint(1, 600), draw.randint(1, 4096)]) for _ in range(draw.randint(1, 7))]
        ratios.append(packed_cost(packing.best_fit(sizes)[1]) / cheapest_packing(sizes))
    assert min(ratios) >= 1 - 1e-9 and max(ratios) <= 1.25 and sum(ratios) / len(ratios) <= 1.03
    assert sum(r < 1 + 1e-9 for r in ratios) >= 30


def test_packing(documents, rough):
    for docs in (documents, rough, rough.limit(0)):
        sizes = Counter()
        rows = Counter()
        for r in docs.select("doc_id", "text").collect():
            sizes[r["doc_id"]] += len([w for w in SPACE.split(r["text"] or "") if w])
            rows[r["doc_id"]] += 1
        got = packing.pack(docs, shard=50).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, packing.pack(docs.repartition(5), shard=50).collect()))
        held, lengths = defaultdict(list), {}
        found, firsts = Counter(), Counter()
        for r in got:
            found[r["doc_id"]] += r["length"]
            firsts[r["doc_id"]] += r["piece"] == 0
            assert (r["bin_id"] is None) == (r["length"] == 0) and r["start"] == r["piece"] * 4096
            if r["length"]:
                held[r["bin_id"]].append((r["bin_offset"], r["length"]))
                lengths.setdefault(r["bin_id"], set()).add(r["bin_length"])
        assert found == sizes and firsts == rows
        for name, items in held.items():
            items.sort()
            (length,) = lengths[name]
            used = sum(n for _, n in items)
            assert items[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(items, items[1:]))
            assert used <= length and not any(used <= x < length for x in packing.LENGTHS)
    wide = sum(lengths_ for lengths_ in (r["length"] for r in got))
    assert wide >= 0


def test_packing_wastes_little(spark):
    got = queries.op7_packing(spark, "/root/testdata/sf0.01").filter("length > 0")
    bins = got.groupBy("bin_id").agg(F.max("bin_length").alias("room"), F.sum("length").alias("used"))
    total = bins.agg(F.sum("used") / F.sum("room")).first()[0]
    assert total > 0.95


def test_unrelated_long_texts_are_not_alike():
    draw = np.random.default_rng(2)
    long = [" ".join(map(str, draw.integers(0, 10 ** 9, 300_000).tolist())) for _ in range(2)]
    a, b = fingerprints.signatures(long)
    assert fingerprints.likeness(a[None], b[None])[0] <= 1 / 128
    assert len(np.unique(a)) >= 120


def test_search_finds_all_alike(spark, rough, texts):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(rough.filter("doc_id in (2, 3, 4)").selectExpr("doc_id + 10000 as doc_id", "text"))
    pairs, members = fingerprints.search(docs, F.col("doc_id") % 10 == 0)
    of = defaultdict(set)
    for r in members.collect():
        of[r["class"]].add(r["doc_id"])
    found = {(a, b): r["jaccard"] for r in pairs.collect() for a in of[r["query_class"]] for b in of[r["class"]]}
    sets = {i: plain_shingles(t) for i, t in texts(docs)}
    for i in (i for i in sets if i % 10 == 0):
        for k, other in sets.items():
            either = len(sets[i] | other)
            alike = len(sets[i] & other) / either if either else 1.0
            assert (alike >= 0.8) == ((i, k) in found)
            assert alike < 0.8 or found[i, k] == pytest.approx(alike)
    assert len(found) > len([i for i in sets if i % 10 == 0])
    assert fingerprints.search(docs.limit(0))[0].count() == 0


def plain_recurring(rows, wildcards, same_docs, short_docs):
    """Doc and line of recurring lines by brute force over the sets of runs."""
    held, lines = defaultdict(set), []
    for i, t in rows:
        for n, line in enumerate(t.split("\n")):
            raw = [w for w in SPACE.split(line) if w]
            words = ["<*>" if re.search("[0-9]", w) else w for w in raw]
            if raw and i is not None:
                width = max(1, -(-(len(words) - 3) // 4))
                runs = [(k, r) for k in range(4) if (r := tuple(words[3 + k * width:3 + (k + 1) * width]))]
                lines.append((i, n, raw, words, (len(words), *words[:3]), runs))
    docs = defaultdict(set)
    for i, _, _, _, leaf, runs in lines:
        for r in runs:
            docs[leaf, r].add(i)
    found = []
    for i, n, raw, words, leaf, runs in lines:
        names = []
        if len(raw) >= 5:
            shared = [r for r in runs if len(docs[leaf, r]) > 1]
            sets = [c for k in range(1, 5) for c in combinations(shared, k)] if wildcards else [tuple(shared)]
            names += [(3, leaf, c) for c in sets if c and sum(len(r) for _, r in c) + 3 >= 0.6 * len(raw)]
        if same_docs and len(raw) >= 5 or short_docs and len(raw) < 5:
            names.append((same_docs if len(raw) >= 5 else short_docs, "same", tuple(raw)))
        if short_docs and len(raw) < 5 and len(raw) - words.count("<*>") >= 0.6 * len(raw):
            names.append((short_docs, "short", tuple(words)))
        for name in names:
            held[name].add(i)
            found.append((i, n, name))
    return {(i, n) for i, n, name in found if len(held[name]) >= name[0] and i != min(held[name])}


def test_fields_whose_values_recur(spark, documents, rough, texts):
    # Each city and each topic in five documents, each pair in one.
    made = spark.createDataFrame([(5 * a + b, f"Posted by the office of {'ABCDE'[a]}city for all readers on {'VWXYZ'[b]}topic today")
                                  for a in range(5) for b in range(5)], "doc_id long, text string")
    assert line_dedup.recurring_lines(made).count() == 0
    for docs in (made, documents, rough, rough.limit(0)):
        got = [tuple(r) for r in line_dedup.recurring_lines(docs, wildcards=True).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_recurring(texts(docs), True, None, None)
    assert {r["doc_id"]: r["dropped_lines"] for r in line_dedup.line_report(made).collect()} == {
        k: int(k > 0) for k in range(25)}


def test_equal_lines_of_two_documents(spark, documents, rough, texts):
    line = "This long passage of the year 2024 stands in two documents word for word"
    made = spark.createDataFrame([(1, line + "\nNo digit is in this line of text either"), (2, line.replace("2024", "2023")),
                                  (3, "x\n" + line + "\nNo digit is in this line of text either")], "doc_id long, text string")
    for docs in (made, documents, rough):
        for wildcards in (False, True):
            got = [tuple(r) for r in line_dedup.recurring_lines(docs, wildcards=wildcards, same_docs=2).collect()]
            assert len(got) == len(set(got)) and set(got) == plain_recurring(texts(docs), wildcards, 2, None)
    two = made.filter("doc_id <> 2")
    assert {r["doc_id"]: r["dropped_lines"] for r in line_dedup.line_report(two).collect()} == {1: 0, 3: 2}
    assert {r["doc_id"]: r["dropped_lines"] for r in line_dedup.line_report(made.filter("doc_id < 3")).collect()} == {1: 0, 2: 0}


def test_short_lines(spark, documents, rough, texts):
    made = spark.createDataFrame([(k, f"All rights reserved.\nPage {k}\n \t\nCopyright {k} Some Company\nonly {'abc'[k]}\n7") for k in range(3)],
                                 "doc_id long, text string")
    for docs in (made, documents, rough):
        got = [tuple(r) for r in line_dedup.recurring_lines(docs, **line_dedup.ALL).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_recurring(texts(docs), True, 2, 3)
    assert {r["doc_id"]: r["dropped_lines"] for r in line_dedup.line_report(made).collect()} == {0: 0, 1: 3, 2: 3}
    assert line_dedup.recurring_lines(made.filter("doc_id < 2"), **line_dedup.ALL).count() == 0
