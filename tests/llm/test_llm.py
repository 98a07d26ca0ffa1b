"""Operators of the llm subpackage against brute force, round trips and held-out labels, on small tables with edge rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict


import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import bpe, bytebpe, exact_dedup, minhash, mixing, pii, quoting, rans, sharding, simhash, tokenfile, toxicity
from corpusloom.llm.common import QUERIES
from corpusloom.session import scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, shard int, kept boolean, word string, hi long"


def words(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, odd signs, and columns whose names the operators use."""
    long = words(1, 20_000)
    texts = [(0, "one two three four five six"), (1, None), (2, ""), (3, "   \n\t "), (4, "x"), (5, "x"), (6, long), (7, long + " more"),
             (8, "Naïve café “quoted” – don't we'll I've 12½ 漢字 😀 <|endoftext|> end"), (9, "x"), (9, "x"), (None, "no id at all here now"), (10, words(2, 300)),
             (11, words(2, 300).replace("a", "a", 1) + " tail"), (12, "a  b c\r\n d")]
    rows = [(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", 1, 7, 0.5, 3, True, "w", 4) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def hf():
    return Tokenizer.from_file(bpe.VOCABULARY)


# 4: exact de-duplication


def test_exact_dedup_edges(edge, none):
    got = exact_dedup.dedup(edge, carry=["doc_id", "text"]).collect()
    assert len(got) == edge.count()
    groups = defaultdict(list)
    for r in got:
        groups[r["text"] or ""].append(r)
    for g in groups.values():
        ids = [r["doc_id"] for r in g if r["doc_id"] is not None]
        assert {r["group_size"] for r in g} == {len(g)}
        assert {r["keep_id"] for r in g} == {max(ids, default=None)}
        assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in g)
    assert {r["keep_id"] for r in exact_dedup.dedup(edge, keep="smallest").collect()} == {0, 1, 3, 4, 6, 7, 8, None, 10, 11, 12}
    assert exact_dedup.dedup(none).count() == 0


def test_exact_dedup_colliding_digests(edge):
    """With a digest that all texts share, only the bytes tell them apart."""
    want = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.dedup(edge).collect()}
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.dedup(edge, digest=lambda t: F.lit("same")).collect()}
    assert got == want


# 3: sharding


def test_shards_are_even_and_gapless(docs, none):
    rows = sharding.shard_documents(docs, 7).collect()
    assert len(rows) == docs.count()
    load, places = Counter(), defaultdict(list)
    for r in rows:
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) - min(load.values()) <= max(r["size"] for r in rows)
    assert sharding.shard_documents(none, 3).count() == 0


def test_shards_edges(edge):
    rows = sharding.shard_documents(edge, 3).collect()
    assert len(rows) == edge.count() and {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {16}


def test_map_edits_move_little(spark, tmp_path):
    draw = random.Random(3)
    weight = [draw.randint(0, 1000) for _ in range(512)]
    old = sharding.SlotMap.first(8, 512).rebalanced(weight, 8)
    new = old.rebalanced(weight, 9)
    moved = [s for s in range(512) if old.owner[s] != new.owner[s]]
    assert len(moved) < 512 / 9 * 1.6 and sum(new.owner[s] == 8 for s in moved) > 0.7 * len(moved)
    load = new.loads(weight, 9)
    assert max(load) - min(load) <= 1000
    gone = new.rebalanced(weight, 8)
    assert max(gone.owner) == 7 and gone.version == new.version + 1
    path = str(tmp_path / "map")
    old.write(spark, path)
    new.write(spark, path)
    assert sharding.SlotMap.read(spark, path) == new and sharding.SlotMap.read(spark, path, old.version) == old


# 6: mixing


def water(sizes, weights, share, most):
    """Targets by repeated sharing out."""
    due, left, target = share * sum(sizes.values()), dict(weights), {}
    while left:
        unit = due / sum(left.values())
        above = [s for s in left if left[s] * unit > most * sizes[s]]
        if not above:
            target |= {s: w * unit for s, w in left.items()}
            break
        for s in above:
            target[s] = most * sizes[s]
            due -= target[s]
            del left[s]
    return target


def test_mix_targets_and_copies(docs):
    rows = QUERIES["op6_mixing"](docs.sparkSession, "/root/testdata/sf0.01").collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    order = sorted(sizes)
    want = water(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5, 2.0)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.03)
    again = QUERIES["op6_mixing"](docs.sparkSession, "/root/testdata/sf0.01").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mix_edges(edge, none):
    got = mixing.mix(edge, [3, 1, 2]).collect()
    assert len(got) == edge.count()
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["doc"]["text"] or "")) and 0 <= r["copies"] <= 2 for r in got)
    assert mixing.mix(none, [1]).count() == 0


def test_equal_records_share_out_their_copies(spark):
    """A record that is repeated a thousand times takes what it is due as a whole, and its rows differ by one copy at most."""
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("k"), F.when(F.col("id") % 2 == 5, F.lit("s")).alias("source"),
                                    F.lit(4).cast("long").alias("size"), F.lit(1.25).alias("rate"), F.lit("kept").alias("other"))
    got = mixing.pivotal_copies(rows, ["k"]).toPandas()
    assert len(got) == 3000 and set(got["copies"]) == {1, 2} and set(got["other"]) == {"kept"}
    assert got[got["k"] == 7]["copies"].sum() == 1250 and abs(got["copies"].sum() - 3750) <= 1


def test_pivotal_counts_are_kept(spark):
    rows = spark.range(5000).select(F.col("id"), F.lit("s").alias("source"), (F.col("id") % 50 + 1).alias("size"), F.lit(0.3).alias("rate"))
    got = mixing.pivotal_copies(rows, ["id"]).select("size", "copies").toPandas()
    assert set(got["copies"]) == {0, 1} and abs(got["copies"].sum() - 1500) <= 1
    assert (got["size"] * got["copies"]).sum() == pytest.approx(0.3 * got["size"].sum(), rel=0.01)


# 7: BPE


def test_splitter_agrees_with_the_library(hf):
    draw = random.Random(1)
    signs = ["a", "s", "re", "ve", "ll", "'", " ", "  ", "\n", "\t", ".", "12", "é", "²", "\x85", "\xa0", "_", "…", "–", "\x00", "漢", "😀", "<|endoftext|>", "<|"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 12))) for _ in range(3000)] + [f"a{chr(c)}b {chr(c)}{chr(c)} '{chr(c)}1" for c in range(0x400)]
    numbers = bytebpe.Numbered()
    code, counts = bytebpe.numbered_words(texts, numbers, bytebpe.specials(bpe.VOCABULARY))
    ids, n = bytebpe.encode_words(list(numbers), bpe.VOCABULARY)
    for text, part in zip(texts, np.split(code, np.cumsum(counts)[:-1])):
        got = bytebpe.gather(ids, np.cumsum(n) - n, n, part)
        want = hf.encode(text, add_special_tokens=False).ids
        assert got.tolist() == want
        assert bytebpe.decode_ids(np.array(want, np.int64), bpe.VOCABULARY).decode("utf-8", "replace") == hf.decode(want, skip_special_tokens=False)


def digests(hf, text):
    ids = hf.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(hf.decode(ids, skip_special_tokens=False))


def test_bpe_digests(edge, none, docs, hf):
    for df in (edge, docs):
        want = Counter((r["doc_id"], *digests(hf, r["text"])) for r in df.collect())
        assert Counter(map(tuple, bpe.digests(df.select("doc_id", "text")).collect())) == want
    assert bpe.digests(none).count() == 0


def test_bpe_columns_of_the_same_names_stay(edge):
    taken = edge.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("mine"))
    back = bpe.decode(bpe.encode(taken), "ids_")
    assert [c for c in back.columns if c.startswith(("ids", "decoded"))] == ["ids", "decoded", "ids_", "decoded_"]
    assert {(r["ids"], r["decoded"]) for r in back.collect()} == {(1, "mine")}


def test_bpe_encode_then_decode(edge):
    back = bpe.decode(bpe.encode(edge), "ids").select("doc_id", "decoded", "word").collect()
    assert Counter((r["doc_id"], r["decoded"]) for r in back) == Counter((r["doc_id"], r["text"] or "") for r in edge.collect())
    assert {r["word"] for r in back} == {"w"}


# 2: token files


@pytest.mark.parametrize("n", [0, 1, 5, rans.LANES, 3 * rans.LANES + 1, rans.CHECKPOINT * rans.LANES + 17])
def test_rans_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50_000).astype(np.uint32)
    table = rans.Table.scaled(np.bincount(ids, minlength=3) if n else np.zeros(0))
    assert table.freq.sum() == 1 << rans.SCALE
    data, parts = rans.encode(ids, table)
    stream = np.frombuffer(data, "<u4")
    got = [rans.decode_part(stream, p, n, table) for p in reversed(rans.unpack_parts(rans.pack_parts(parts)))]  # in any order
    assert np.concatenate([np.zeros(0, np.uint32), *got[::-1]]).tolist() == ids.tolist()


def test_rans_sees_damage():
    ids = np.arange(5000, dtype=np.uint32) % 100
    table = rans.Table.scaled(np.bincount(ids))
    data, parts = rans.encode(ids, table)
    parts[0].crc32 ^= 1
    with pytest.raises(ValueError):
        rans.decode_part(np.frombuffer(data, "<u4"), parts[0], 5000, table)


def test_token_file(spark, edge, none, docs, hf):
    for df in (docs, edge):
        path = scratch(spark, "tokens")
        tokenfile.write_tokens(df, path)
        want = Counter((r["doc_id"], tuple(hf.encode(r["text"] or "", add_special_tokens=False).ids + [0])) for r in df.collect())
        got = tokenfile.read_tokens(spark, path).collect()
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
        at = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at
            at += len(r["ids"])
        ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
        assert ids == sorted(ids)
        for r in tokenfile.token_digests(spark, path).collect():
            assert any(r["ids_crc32"] == zlib.crc32(np.array(g["ids"], "<u4").tobytes()) for g in got if g["start"] == r["start"])
    path = scratch(spark, "tokens")
    tokenfile.write_tokens(none, path)
    assert tokenfile.read_tokens(spark, path).count() == 0


# 5: SimHash


def test_edited_texts(docs, edge, none):
    for df in (docs, edge.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = sorted(df.select("doc_id", "text").collect(), reverse=True)
        got = {r["doc_id"]: r for r in simhash.edited_fingerprints(df).collect()}
        assert len(got) == len(rows)
        prints = defaultdict(set)
        for k, (i, t) in enumerate(rows):
            t, after = t or "", rows[(k + 1) % len(rows)]
            half = len(t) // 2
            edited = t[: len(t) - half] + (after[1] or "")[:half]
            r = got[i]
            assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            prints[t].add(r["fingerprint"])
            bits = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
            assert r["near_edited"] == pytest.approx(1 - bits(r["fingerprint"], r["edited_fingerprint"]) / 128)
            assert r["near_next"] == pytest.approx(1 - bits(r["fingerprint"], got[after[0]]["fingerprint"]) / 128)
        assert all(len(p) == 1 for p in prints.values())
    assert simhash.edited_fingerprints(edge).count() == edge.count()
    assert simhash.edited_fingerprints(none).count() == 0


def test_fingerprint_votes(spark):
    rows = spark.createDataFrame([(1, "alpha be alpha"), (2, "  "), (3, None)], "id long, text string")
    hashes = {w: spark.range(1).select(F.xxhash64(F.lit(w)), F.xxhash64(F.lit(w), F.lit(1))).first() for w in ("alpha", "be")}
    votes = [0] * 128
    for w, weight in (("alpha", 25), ("alpha", 25), ("be", 4)):
        for h in range(2):
            for i in range(64):
                votes[64 * h + i] += weight if hashes[w][h] >> i & 1 else -weight
    want = [sum(1 << i for i in range(64) if votes[64 * h + i] > 0) for h in range(2)]
    got = {r["id"]: (r["hi"] % 2**64, r["lo"] % 2**64) for r in simhash.fingerprints(rows, ["id"]).collect()}
    assert got == {1: tuple(want), 2: (0, 0), 3: (0, 0)}


def test_search_finds_all_within_the_radius(spark):
    draw = random.Random(9)
    base = [draw.getrandbits(128) for _ in range(40)]
    prints = [(k, v) for k, v in enumerate(base)]
    for k in range(40, 200):
        v = base[draw.randrange(40)]
        for b in draw.sample(range(128), draw.randint(0, 5)):
            v ^= 1 << b
        prints.append((k, v))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(k, signed(v & (2**64 - 1)), signed(v >> 64)) for k, v in prints], "id long, hi long, lo long")
    got = {(r["query_id"], r["id"], r["distance"]) for r in simhash.search(df.filter("id % 10 = 0"), df).collect()}
    want = {(a, b, d) for a, x in prints if a % 10 == 0 for b, y in prints if (d := bin(x ^ y).count("1")) <= 3}
    assert got == want


def test_near_counts_are_brute_force(spark):
    """Distinct prints, copies, many prints around one (a hot key in every table), and rows without an id."""
    draw = random.Random(8)
    flip = lambda x, n: x ^ sum(1 << b for b in draw.sample(range(128), n))
    centre = draw.getrandbits(128)
    prints = [draw.getrandbits(128) for _ in range(60)] + [flip(centre, draw.randint(0, 5)) for _ in range(150)] + [centre] * 9 + [0] * 5
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    rows = [(i if i % 17 else None, signed(p >> 64), signed(p % 2**64)) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "doc_id long, hi long, lo long")
    want = sorted((str(i), None if i is None or i % 10 else sum((p ^ q).bit_count() <= 3 for q in prints) - 1) for (i, _, _), p in zip(rows, prints))
    for blocks in (4, 8):
        got = simhash.near_counts(df, F.col("doc_id") % 10 == 0, blocks=blocks).collect()
        assert sorted((str(r["doc_id"]), r["near_count"]) for r in got) == want and max(w[1] or 0 for w in want) > 40


# 1: near-duplicates


def shingle_sets(texts):
    out = {}
    for i, t in texts.items():
        w = t.split()
        k = min(5, len(w))
        out[i] = {tuple(w[a:a + k]) for a in range(len(w) - k + 1)} if w else set()
    return out


def test_near_classes_of_planted_copies(spark):
    rows, group = [], {}
    for g in range(12):
        text = words(100 + g, 200).split()
        for c in range(6):
            new = list(text)
            if c:
                new[20 * c] = f"edit{c}"
            rows.append((len(rows), " ".join(new)))
            group[len(rows) - 1] = g
    rows += [(len(rows) + k, words(900 + k, 150)) for k in range(40)]
    got = {r["doc_id"]: r for r in minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i in got:
        same = [j for j, g in group.items() if g == group.get(i)] if i in group else [i]
        assert got[i]["class_id"] == min(same) and got[i]["class_size"] == len(same) and got[i]["kept"] == (i == min(same))


def test_near_classes_hold_all_similar_pairs(docs):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    sets, got = shingle_sets(texts), {r["doc_id"]: r["class_id"] for r in minhash.near_classes(docs).collect()}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.82 * len(sets[a] | sets[b])]
    assert all(got[a] == got[b] for a, b in pairs)
    for a in sets:  # classes hold similar texts only
        if got[a] != a:
            assert max(len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) for b in sets if b != a and got[b] == got[a]) > 0.7 or texts[a] in [texts[b] for b in sets if b != a]


def template_pages(n, own, edits, paired=1):
    """Pages of one long template with ``own`` words each, every ``paired``-th beside a near copy of its own; other pages are less alike."""
    template, rows = words(40, 600).split(), []
    for g in range(n):
        page = template[:300] + words(5000 + g, own).split() + template[300:]
        for c in range(1 + (g % paired == 0)):
            new = list(page)
            for e in range(edits):
                new[(37 * g + 41 * c + 97 * e) % len(new)] = f"edit{g}x{c}x{e}"
            rows.append((len(rows), " ".join(new)))
    return rows


def unlinked(spark, rows):
    """Pairs that share a bucket and are similar by brute force, and those of them in different classes."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    idf = minhash.idf_table(df, "text")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(df).collect()}
    bands = {r["doc_id"]: set(r["bands"]) for r in minhash.signatures(df, idf, "doc_id", "text").collect()}
    with np.errstate(over="ignore"):
        sets = {i: minhash.shingles(minhash.word_hashes(t, minhash.Words()), idf) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and bands[a] & bands[b] and minhash.similarity(sets[a], sets[b]) >= minhash.THRESHOLD]
    return pairs, [(a, b) for a, b in pairs if got[a] != got[b]]


@pytest.mark.parametrize("block, most_blocks, few", [(1024, 16, 24), (8, 100, 3), (16, 1, 3)])
@pytest.mark.parametrize("n, own, paired, least", [(60, 40, 1, 55), (120, 14, 20, 5)])
def test_near_copies_in_a_crowd_of_one_template(spark, monkeypatch, block, most_blocks, few, n, own, paired, least):
    """A page's partner is found however many other pages of the template share its buckets: in one block, in several, and by rare shingles."""
    for name, value in (("BLOCK", block), ("MOST_BLOCKS", most_blocks), ("FEW", few)):
        monkeypatch.setattr(minhash, name, value)
    pairs, lost = unlinked(spark, template_pages(n, own, 4, paired))
    assert len(pairs) >= least and not lost


def test_overlaps_are_weighted_intersections(monkeypatch):
    monkeypatch.setattr(minhash, "FEW", 4)
    draw = np.random.default_rng(3)
    idf = draw.uniform(1, 9, minhash.COUNTERS).astype(np.float32)
    with np.errstate(over="ignore"):
        texts = [" ".join("abc"[k] for k in draw.integers(0, 3, n)) for n in (2, 5, 9, 30, 200, 400, 400, 900)] + ["p q r s t u"] * 3
        hashes = [minhash.word_hashes(t, minhash.Words()) for t in texts]
        got = minhash._overlaps([minhash.counted(h, idf) for h in hashes])
        for i, a in enumerate(hashes):
            for j, b in enumerate(hashes):
                if i != j:
                    x, y = (dict(zip(*map(list, minhash.shingles(h, idf)))) for h in (a, b))
                    assert got[i, j] == pytest.approx(sum(min(w, y.get(k, 0)) for k, w in x.items()), rel=1e-4)


def test_near_classes_edges(edge, none):
    got = minhash.near_classes(edge).collect()
    assert len(got) == edge.count()
    of = {r["doc_id"]: r["class_id"] for r in got}
    assert of[6] == of[7] == 6 and of[4] == of[5] == of[9] == 4 and of[1] == of[2] == 1 and of[3] == 3
    assert minhash.near_classes(none).count() == 0


def test_samples_follow_weighted_jaccard():
    draw = np.random.default_rng(4)
    with np.errstate(over="ignore"):
        x = minhash._mix(np.arange(1, 401, dtype=np.uint64) * minhash.M1)
        w = draw.uniform(1, 5, 400).astype(np.float32)
        a, b = (np.sort(x[:300]), w[np.argsort(x[:300])]), (np.sort(x[100:]), w[100:][np.argsort(x[100:])])
        true = minhash.similarity(a, b)
        hits = []
        for salt in range(40):  # other elements of the same weights
            y = minhash._mix(x ^ np.uint64(salt * 7919 + 1))
            hits.append((minhash.sample(y[:300], w[:300]) == minhash.sample(y[100:], w[100:])).mean())
    assert np.mean(hits) == pytest.approx(true, abs=0.05)


# 9: toxicity


def errors(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    if a == b:
        return 0
    if len(a) == len(b):
        return 1 if sum(x != y for x, y in zip(a, b)) == 1 else 2
    a, b = sorted((a, b), key=len)
    return 1 if any(b[:k] + b[k + 1:] == a for k in range(len(b))) else 2


def test_automaton_agrees_with_edit_distance():
    terms = ["idiot", "moron", "scum", "stupid", "stupids", "trash"]
    auto, draw = toxicity.TermAutomaton(terms), random.Random(2)
    for _ in range(4000):
        w = list(draw.choice(terms))
        for _ in range(draw.randint(0, 2)):
            k = draw.randrange(len(w) + 1)
            w[k:k + draw.randint(0, 1)] = draw.choice(["", "a", "o", "t", "x"])
        w = "".join(w)
        near = [(e, t) for t in terms if (e := errors(w, t)) <= (len(t) >= toxicity.FUZZY_LENGTH)]
        got = auto.match(w)
        assert (got is None) == (not near) and (got is None or got[0] == min(near)[0]), w


def test_quotation():
    text = 'they said "you idiot" but\n> an idiot\nidiot “no idiot here” idiot'
    found = [toxicity.quoted(text, m.start(), m.end()) for m in re.finditer("idiot", text)]
    assert found == [True, True, False, True, False]


def test_toxicity_on_held_out_labels(spark):
    out = QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    got = out.join(labels, "doc_id").filter("held_out").select("toxic", "predicted", "score").toPandas()
    hit = ((got["toxic"] == 1) & (got["predicted"] == 1)).sum()
    assert hit >= 0.9 * (got["toxic"] == 1).sum() and hit >= 0.95 * (got["predicted"] == 1).sum()
    assert got["score"].between(0, 1).all()


def test_toxicity_edges(spark, edge, none):
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (4, None), (6, 0)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        model = toxicity.train(edge, known)
        assert toxicity.scored(edge, model).filter("score between 0 and 1 and score <> 0.5").count() == edge.count()  # the caller's score is replaced
    assert toxicity.scored(none, toxicity.train(none, labels), score="s").count() == 0


# fixed patterns of 10


def test_ip_parts_of_any_length():
    assert [x[2] for x in pii.base_spans(f"a {'0' * 900}7.1.{'0' * 5000}.255 b")] == ["ip"]
    assert pii.base_spans(f"a 1.2.{'0' * 500}256.4 b") == [] and pii.base_spans("1.2.3.2560") == []


# 10: personal data


def test_base_spans_agree_with_the_patterns():
    draw = random.Random(8)
    bits = ["a@b.c", "x", "@", ".", "1", "22", "256", "4000 0000 0000 0002", "+1 (555) 123-4567", " ", "-", "(", ")", "%", "é", "+", "\n", "1.2.3.4.5", "4111111111111111"]
    for _ in range(4000):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(1, 14)))
        want = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m.group().split("."))) <= 255]
        want += [(*m.span(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := pii.digits_of(m.group())) <= 19 and pii.luhn(d)]
        want += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(pii.digits_of(m.group())) <= 15]
        assert pii.base_spans(text) == sorted(want, key=lambda s: (s[0], pii.KINDS.index(s[2]))), text


def test_posteriors_and_best_agree_with_enumeration():
    text = "call (555) 123-4567 or 10.0.0.1 now"
    lat = pii.lattice(text, 0, len(text))
    field = pii.Field()
    score = np.random.default_rng(1).normal(0, 2, len(lat.candidates))

    def ways(at):
        if at == len(lat.units):
            return [[]]
        return ways(at + 1) + [[k, *w] for k, c in enumerate(lat.candidates) if c[0] == at for w in ways(c[1])]

    every = ways(0)
    mass = np.array([np.exp(sum(score[k] for k in w)) for w in every])
    want = [sum(m for m, w in zip(mass, every) if k in w) / mass.sum() for k in range(len(score))]
    assert field.posteriors(lat, score) == pytest.approx(want)
    assert field.best(lat, score) == max(every, key=lambda w: sum(score[k] for k in w))


def test_field_adds_disguised_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    model = pii.train(docs)
    texts = [("write to jane.doe at mail3 dot example dot com soon", "email"), ("host 10[.]20[.]30[.]40 down", "ip"), ("ring (555) 123-4567 today", "phone")]
    for text, kind in texts:
        assert [k for *_, k in model.spans(text, pii.base_spans(text))] == [kind], text
    assert model.spans("we met at the dot of nine in 1999 with 12 friends", []) == []
    found = pii.find_spans(docs, model, ["doc_id"]).select(F.sum(F.size(F.filter("spans", lambda s: ~s["base"]))), F.sum(F.size("spans"))).first()
    assert found[0] <= 0.05 * found[1]


def test_every_disguised_address_is_found_alone(spark):
    """Each spelling that the field is trained for is read without a digit, @ or spaced dot elsewhere in the text."""
    model = pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"))
    forms = ["jane at example dot com", "jane [at] example [dot] com", "jane(at)example(dot)com", "jane (at) example (dot) com", "jane @ example.com",
             "jane [at] example.com", "jane (at) example.com", "jane[at]example[dot]com"]
    df = spark.createDataFrame([(k, f"please write to {f} about it") for k, f in enumerate(forms)], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["spans"]] for r in pii.find_spans(df, model, ["doc_id"]).collect()}
    assert [f for k, f in enumerate(forms) if got[k] != [(16, 16 + len(f), "email")]] == []
    assert model.spans("they looked at things.Then they left", []) == []


def test_pii_edges(edge, none):
    model = pii.train(edge)
    assert pii.find_spans(edge, model, ["doc_id"]).count() == edge.count()
    assert pii.find_spans(none, pii.train(none), ["doc_id"]).count() == 0
    assert pii.masked(edge, model).select("word").distinct().count() == 1


def test_masking(spark):
    df = spark.createDataFrame([(1, "a@b.co and 1.2.3.4"), (2, None)], "doc_id long, text string")
    assert [r["text"] for r in pii.masked(df, pii.Field()).orderBy("doc_id").collect()] == ["[email] and [ip]", None]


# 8: quotation linking


def test_quotes_are_linked_and_ordered(spark, none):
    rows = [
        (1, 0, "user", "First point. Second point.\nThird point."), (1, 1, "assistant", "A reply."), (1, 2, "user", "Another thing."),
        (1, 3, "assistant", "On Monday someone wrote:\n> First  point.\n> second POINT.\nI agree with that."),
        (1, 4, "user", "> > First point.\n> I agree with that.\nGood."), (1, 5, "user", "> Nobody said this.\nHm."),
        (2, 0, "user", "> quoted only"), (2, 1, None, None), (None, None, "user", "lost"), (2, 0, "user", "twice")]
    got = quoting.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    one = {r["turn"]: r for r in got if r["conv_id"] == 1}
    assert one[3]["text"] == "I agree with that." and one[3]["reply_to"] == 0 and one[3]["n_linked"] == 1
    assert one[4]["reply_to"] == 3 and one[4]["n_quotes"] == 2 and one[4]["text"] == "Good."
    assert one[5]["reply_to"] == 4 and one[5]["n_linked"] == 0
    assert [t for _, t in sorted((r["place"], t) for t, r in one.items())] == [0, 3, 4, 5, 1, 2]
    assert one[3]["depth"] == 1 and one[1]["depth"] == 0 and one[3]["chat"] == "<|assistant|>\nI agree with that.\n"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quoting.linked_conversations(empty).count() == 0


def test_whole_passages_go_before_stock_sentences(spark):
    rows = [(1, 0, "user", "Thanks. Agreed."), (1, 1, "user", "Well."), (1, 5, "user", "Thanks. Agreed. Ship on Monday."), (1, 6, "user", "> Thanks. Agreed. Ship on Monday.\nYes."),
            (1, 7, "user", "> Thanks. Agreed.\nNo."), (None, 0, "user", "Thanks. Agreed."), (None, 1, "user", "Thanks. Agreed. Go."), (None, 2, "user", "> Thanks.\n> Agreed. Go.\nOk.")]
    got = quoting.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    to = {(r["conv_id"], r["turn"]): r["reply_to"] for r in got}
    assert len(got) == len(rows) and to[1, 6] == 5 and to[1, 7] == 0 and to[None, 2] == 1


def test_deep_branches(spark):
    """A chain of branches, each quoting the message two before it."""
    rows = [(7, k, "user", (f"> Line {k - 2} here.\n" if k >= 2 else "") + f"Line {k} here.") for k in range(24)]
    got = quoting.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    depth = {r["turn"]: r["depth"] for r in got}
    assert depth[23] == max(depth.values()) and sorted(r["place"] for r in got) == list(range(1, 25))
    assert all(r["reply_to"] == r["turn"] - 2 for r in got if r["turn"] >= 2)


def brute_threads(rows):
    """reply_to, n_linked, depth and place of each (conversation, turn), by nested loops over the turns of each conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = {t: quoting.parse(text or "") for c, t, _, text in rows if c == conv}
        anchor, path, reply, linked = None, {}, {}, {}
        for t in sorted(turns):
            found = []
            for level, _, units in turns[t][2]:
                votes = Counter(first for u in units if (first := min((x for x in turns if u in turns[x][1]), default=t)) < t)
                if votes:
                    run = [x for x in sorted(turns) if x < t and any(turns[x][1][i:i + len(units)] == units for i in range(len(turns[x][1])))]
                    said = run[0] if run and len(units) > 1 else max(votes, key=lambda x: (votes[x], x))
                    found.append((level, -said))
            linked[t] = len(found)
            to = -min(found)[1] if found else None
            if to is not None and to != t - 1:
                anchor = to
            reply[t] = to if to is not None else t - 1 if t > 0 else None
            path[t] = [*(path[anchor] if anchor is not None else []), t]
        for place, t in enumerate(sorted(turns, key=path.get)):
            out[conv, t] = (reply[t], linked[t], len(path[t]) - 1, place + 1)
    return out


def test_random_threads_are_linked_as_by_nested_loops(spark):
    """Few stock sentences, so most are said many times; quotes of whole turns, of parts, of several turns and of nobody, nested; one conversation holds a third."""
    draw = random.Random(21)
    sentence = lambda: f"{draw.choice('No Yes Well Then'.split())} {draw.choice('we go they stay it rains'.split())}."
    rows = []
    for conv in [None, *range(25)]:
        said = []
        for t in range(120 if conv == 3 else draw.randint(1, 14)):
            lines = []
            for _ in range(draw.choice([0, 0, 1, 1, 2])):
                source = draw.choice(said) if said and draw.random() < 0.9 else [sentence()]
                a = draw.randrange(len(source))
                part = source[a:a + draw.randint(1, 4)] or source
                sign = ">" * draw.randint(1, 3)
                lines += [f"{sign} {x.upper() if draw.random() < 0.2 else x}" for x in part] + ["---"] * draw.randint(0, 1)
            mine = [sentence() for _ in range(draw.randint(1, 5))]
            said.append(mine)
            rows.append((conv, t, draw.choice(["user", None]), "\n".join([*lines, " ".join(mine)])))
    rows += [(90, 0, "user", "Long words. " * 30_000), (90, 1, "user", "> Long words. Long words.\nSo it is."), (91, 0, "user", ""), (91, 1, "user", "> \n>\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("x")).withColumn("units", F.lit(1))
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["n_linked"], r["depth"], r["place"]) for r in quoting.linked_conversations(df).collect()}
    want = brute_threads(rows)
    assert got == want and sum(w[1] for w in want.values()) > 100 and max(w[2] for w in want.values()) > 2


# the pipeline


def test_pipeline_stages(spark, hf):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    step = dict(corpus_pipeline.STAGES)
    clean = step["toxicity"](spark, docs, sf)
    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op9_toxicity"](spark, sf).collect()}
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == {i for i, p in scores.items() if not p}
    assert clean.columns == docs.columns
    once = step["exact dedup"](spark, clean, sf)
    rows = once.collect()
    assert once.columns == docs.columns and len({r["text"] for r in rows}) == len(rows) == clean.select("text").distinct().count()
    apart = step["MinHash near-dedup"](spark, once, sf)
    kept = {r["doc_id"] for r in apart.collect()}
    want = {r["doc_id"] for r in minhash.near_classes(once).filter("kept").collect()}
    assert kept == want and apart.columns == docs.columns
    mix = step["mixing sources to target weights"](spark, apart, sf)
    assert mix.columns == docs.columns
    copies = Counter(r["doc_id"] for r in mix.collect())
    assert set(copies) <= kept and max(copies.values()) <= 2
    text = {r["doc_id"]: r["text"] for r in rows}
    last = step["BPE encoding"](spark, mix, sf).collect()
    assert Counter(r["doc_id"] for r in last) == copies
    assert all(list(r["ids"]) == hf.encode(text[r["doc_id"]], add_special_tokens=False).ids for r in last)


def test_pipeline_stages_take_edge_rows(spark, edge, none, sf):
    for df in (edge, none):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, sf).count() <= 2 * df.count()


def test_queries_of_sql_twins(spark, sf):
    from check_oracles import compare, connect
    from corpusloom.llm.queries import ORACLES

    con = connect(sf)
    for name, sql in ORACLES.items():
        assert compare(spark, con, sf, name, QUERIES[name], sql).startswith("ok")

