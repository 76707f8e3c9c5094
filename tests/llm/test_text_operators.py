"""The operators that SQL cannot express, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import CLASHES, az, sentence
from pyspark.sql import functions as F

from tabulon.llm import chaining, decontamination as decon, simhash as sim, toxicity as tox
from tabulon.llm.components import components
from tabulon.llm.packing import best_fit_plan, pack
from tabulon.llm import passage_dedup
from tabulon.llm.passage_dedup import fuzzy_passages
from tabulon.llm.secret_scan import base_spans, lexed_literals, scan_secrets
from tabulon.llm.suffix_dedup import repeated_passages
from tabulon.llm.token_counts import token_counts
from tabulon.llm.tokens import LATIN_SPLIT, encoder, tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def test_token_counts(awkward, nothing):
    want = Counter((i, len(t.encode()), n := len(tokenizer(PATH).encode(t, add_special_tokens=False).ids), n > 1024) for i, t in rows_of(awkward))
    for frequent in (4, 32_768):
        assert Counter(map(tuple, token_counts(awkward, PATH, frequent=frequent).collect())) == want
    assert token_counts(nothing, PATH).count() == 0


def test_split_agrees_on_every_latin_character():
    split = tokenizer(PATH).pre_tokenizer
    for c in map(chr, range(0x250)):
        s = f"a{c}b1{c}2 {c}.{c}{c} '{c}s"
        assert LATIN_SPLIT.findall(s) == [s[a:b] for _, (a, b) in split.pre_tokenize_str(s)]


def test_libraries_agree_beyond():
    for code in [*range(0x250, 0x3100, 7), *range(0x4E00, 0x30000, 997)]:
        if not 0xD800 <= code < 0xE000:
            s = f"a{chr(code)}1{chr(code)} {chr(code)}.{chr(code)}"
            assert encoder(PATH).encode_ordinary(s) == tokenizer(PATH).encode(s, add_special_tokens=False).ids


def brute_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", az(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(texts, monkeypatch):
    for block in (4, 7, 100_000):
        monkeypatch.setattr(sim, "BLOCK_WORDS", block)
        for t in texts:
            if t is not None and (len(t) < 3000 or block > 10):
                assert sim.fingerprint(t.encode()) == brute_fingerprint(t)


def brute_components(fps, max_bits):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= max_bits:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash(awkward, nothing):
    got = sim.simhash_components(awkward).collect()
    assert len(got) == awkward.count()
    fps = {r["doc_id"]: int(r["fingerprint"], 16) for r in got if r["doc_id"] is not None}
    assert all(fps[i] == brute_fingerprint(t) for i, t in rows_of(awkward) if i is not None)
    want = brute_components(fps, 3)
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert sim.simhash_components(nothing).count() == 0 and sim.drop_near_copies(nothing).count() == 0
    kept = sim.drop_near_copies(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] not in (None, 500)) == sorted(i for i in set(want.values()) if i != 500)


def test_one_row_of_each_component_stays(spark):
    """Rows without id and ids with several texts: a copy that goes takes no other row with it."""
    rng = random.Random(13)
    a, b, c, d, alone, lone = (sentence(rng, 40) for _ in range(6))
    docs = [
        (3, a), (8, a.upper()), (None, a), (None, alone), (None, lone), (None, b), (None, b.upper()), (None, b.title()),
        (8, sentence(rng, 30)), (9, c), (9, c.upper()), (9, c), (2, d), (2, d),
    ]
    df = spark.createDataFrame([(*r, f"n{i}") for i, r in enumerate(docs)], "doc_id long, text string, mark string").repartition(4)
    kept = sim.drop_near_copies(df)
    assert kept.columns == df.columns
    got = Counter((r["doc_id"], az(r["text"])) for r in kept.collect())
    assert got == Counter({(3, a): 1, (None, alone): 1, (None, lone): 1, (None, b): 1, (8, docs[8][1]): 1, (9, c): 1, (2, d): 1})


@pytest.mark.parametrize("max_bits,bucket", [(3, 8192), (3, 5), (2, 8192), (5, 6)])
def test_near_links_lose_nothing(spark, max_bits, bucket):
    """Clusters of fingerprints a few bits apart, some in buckets that are cut into blocks."""
    rng = random.Random(max_bits)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 40])):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, max_bits)):
                f ^= 1 << b
            fps.add(f)
    want = brute_components({i: f for i, f in enumerate(sorted(fps))}, max_bits)
    number = {f: i for i, f in enumerate(sorted(fps))}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    links = sim.near_links(df, max_bits, bucket)
    pairs = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in links.collect()]
    assert all((a ^ b).bit_count() <= max_bits for a, b in pairs)
    parts = defaultdict(set)
    for r in components(links).collect():
        parts[r["root"]].add(number[r["node"] & (1 << 64) - 1])
    whole = defaultdict(set)
    for i, c in want.items():
        whole[c].add(i)
    assert sorted(map(sorted, parts.values())) == sorted(sorted(v) for v in whole.values() if len(v) > 1)


def test_components_of_a_long_path(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1002, 1002)], "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_secret_spans():
    t = 'password=abc\nTOKEN: "abcdef" AKIA' + "B" * 16 + " AKIAB " + "0a" * 12 + "g" + "f" * 23
    assert [(k, t[a:b]) for a, b, k in base_spans(t)] == [("assign", 'TOKEN: "abcdef'), ("access", "AKIA" + "B" * 16), ("hex", "0a" * 12)]
    assert base_spans("paſſword=abcdefgh to\u212aen=abcdefgh") == []
    flows = 'k = "aB3$kf92LLqpz"\ndb_password = k\nk = "other"\nlabel = "aB3$kf92LLqpq"'
    assert [flows[a:b] for a, b, _ in lexed_literals(flows)] == ["aB3$kf92LLqpz"]
    assert [t[a:b] for t in ['{"clientSecret":"abC9dEf7gH"}'] for a, b, _ in lexed_literals(t)] == ["abC9dEf7gH"]
    for harmless in ("password: changeme", "see: http://x.y/z", "token = ${VAULT_TOKEN}", "a == b", "title: A fine story"):
        assert lexed_literals(harmless) == []


def test_scan_secrets(spark, awkward, nothing):
    got = scan_secrets(awkward).collect()
    assert len(got) == awkward.count()
    assert {r["base_sha256"] for r in got if not r["spans"]} == {hashlib.sha256(b"").hexdigest()}
    one = spark.createDataFrame([(1, "é🙂 token=abcdef")], "doc_id long, text string")
    assert scan_secrets(one).first()["spans"].startswith("assign:3:15")
    assert scan_secrets(nothing).count() == 0


def brute_hits(text, items):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", az(text))
    hit, seen = set(), set()
    for item, t in items:
        ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", az(t))
        for a in range(max(len(ws) - 12, 1) if ws else 0):
            w = ws[a : a + 13]
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    if item is not None:
                        seen.add(str(item))
    items = ",".join(sorted(seen))
    return len(words), len(hit), len(seen), hashlib.sha256(items.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("part_windows", [60_000, 9])
def test_contamination(spark, awkward, texts, nothing, part_windows):
    passage = texts[17].split(" ")[25:60]
    items = [(1, " ".join(passage)), (2, " ".join(passage[:20])), (2, " ".join(passage[:20])), (10, "hello, WORLD"), (3, "one"), (4, None), (5, ""), (None, "two words"), (6, "te " * 40), (7, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r)[:-1] for r in decon.contamination(awkward, bench, part_windows=part_windows).collect())
    assert got == Counter((i, *brute_hits(t, items)) for i, t in rows_of(awkward))
    assert decon.contamination(nothing, bench, part_windows=part_windows).count() == 0
    assert not decon.contamination(awkward, bench.limit(0)).filter("contaminated or n_hit > 0").count()
    kept = decon.drop_contaminated(awkward, bench)
    assert kept.columns == awkward.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({k[0]: 0 for k in got}) + Counter([i for i, t in rows_of(awkward) if not brute_hits(t, items)[-1]])


def serial_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        best = min((g for g in gaps if g >= n), default=None)
        if best is None:
            gaps.append(capacity - n)
        else:
            gaps.remove(best)
            gaps.append(best - n)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_serial_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 200])
    lengths = [rng.randint(1, rng.choice([capacity, max(1, capacity // 3)])) for _ in range(rng.choice([0, 5, 400]))]
    counts = Counter(lengths)
    filled, places = defaultdict(list), Counter()
    for n, low, high, each, first, offset in best_fit_plan(counts, capacity):
        for r in range(low, high + 1):
            places[n] += 1
            filled[first + (r - low) // each].append((offset + (r - low) % each * n, n))
    assert places == counts
    for spans in filled.values():
        spans.sort()
        assert [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]] and sum(n for _, n in spans) <= capacity
    assert sorted(capacity - sum(n for _, n in s) for s in filled.values()) == serial_best_fit(lengths, capacity)


def test_pack(awkward, nothing):
    got = pack(awkward, PATH, capacity=64).collect()
    ids = [(i, [*tokenizer(PATH).encode(t, add_special_tokens=False).ids, 0]) for i, t in rows_of(awkward)]
    want = Counter()
    for i, tokens in ids:
        at, size = 0, len(tokens) % 64 or 64
        for k in range(-(-len(tokens) // 64)):
            piece = np.array(tokens[at : at + size], "<u4").tobytes()
            want[(i, k, at, size, zlib.crc32(piece))] += 1
            at, size = at + size, 64
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    spans = defaultdict(list)
    for r in got:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in spans.values():
        s.sort()
        assert [a for a, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1]] and sum(n for _, n in s) <= 64
    assert len(spans) == len(serial_best_fit([r["length"] for r in got], 64))
    assert pack(nothing, PATH).count() == 0


def exact_passages(rows, least):
    owners, words = defaultdict(set), defaultdict(list)
    for i, t in rows:
        words[i] = t.encode().lower().split()
    for i, w in words.items():
        for a in range(len(w) - least + 1):
            owners[tuple(w[a : a + least])].add(i)
    out = set()
    for i, w in words.items():
        spans = []
        for a in range(len(w) - least + 1):
            if len(owners[tuple(w[a : a + least])]) > 1:
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = a + least
                else:
                    spans.append([a, a + least])
        out |= {(i, a, b) for a, b in spans}
    return out


def test_repeated_passages(awkward, nothing):
    got = {(r["doc_id"], r["start"], r["end"]) for r in repeated_passages(awkward).collect()}
    assert got == exact_passages([r for r in rows_of(awkward) if r[1] != "twice"], 50)
    assert repeated_passages(nothing).count() == 0


def test_repeated_passages_of_many(spark):
    """More documents begin alike than a suffix is compared with, over several tasks."""
    rng = random.Random(3)
    words = sentence(rng, 40).split(" ")
    docs = []
    for i in range(80):
        a, b = rng.randint(0, 15), rng.randint(25, 40)
        docs.append((i, " ".join([*rng.choices(["x", "y"], k=6), *words[a:b], *rng.choices(["x", "y"], k=6)])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {(r["doc_id"], r["start"], r["end"]) for r in repeated_passages(df, least_words=16, kmer=4).collect()}
    assert got == exact_passages(docs, 16)


@pytest.mark.parametrize("n", range(9))
def test_repeated_passages_of_few(spark, n):
    """Tasks with few suffixes or none: n words in each of two documents, over one task and over four."""
    passage = sentence(random.Random(n), 40 + 3 * n)
    docs = spark.createDataFrame([(1, passage), (2, passage), (3, passage + " more")][: 1 + n % 3], "doc_id long, text string")
    for tasks in (1, 4):
        got = {(r["doc_id"], r["start"], r["end"]) for r in repeated_passages(docs.repartition(tasks)).collect()}
        assert got == exact_passages(rows_of(docs), 50)


def test_few_suffixes_in_a_task():
    """0 to 20 suffixes, all alike, of documents of their own."""
    from tabulon.llm import suffix_dedup as sd

    word = bytes(sd.CODE)
    for n in range(21):
        rows = sd._Rows(range(n), [word * 60] * n, [b""] * n, [b""] * n, 60)
        before, after, other = sd._compare(rows, 60, 8)
        assert (after == (60 if n > 1 else 0)).all() and (before == 0).all()
        if n > 1:
            assert list(other[:3]) == [1, 0, 0][: min(n, 3)]


def test_repeated_passages_of_copies_and_a_third(spark):
    """Two copies cover each other; a third document shares with them a rare beginning and a frequent line, and sorts far off."""
    rng = random.Random(11)
    line = sentence(rng, 10)
    around = lambda middle: f"{sentence(rng, 12)} {middle} {sentence(rng, 12)}"
    texts = [around(line) for _ in range(80)]
    for _ in range(12):
        rare = f"{sentence(rng, 8)} {line}"
        copy = around(rare)
        texts += [copy, copy, around(rare)]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = repeated_passages(df, least_words=16, kmer=4).collect()
    assert {(r["doc_id"], r["start"], r["end"]) for r in rows} == exact_passages(docs, 16)
    assert all(r["other_id"] != r["doc_id"] for r in rows)


def test_chains_match_the_quadratic_sum():
    rng = random.Random(1)
    for _ in range(60):
        runs = sorted((rng.randint(0, 80), rng.randint(0, 80), n := rng.randint(3, 9), n) for _ in range(rng.randint(2, 14)))
        value = [0.0] * len(runs)
        for j, (p, s, _, w) in enumerate(runs):
            best = 0.0
            for i, (q, t, n, _) in enumerate(runs):
                if q + n <= p and t + n <= s:
                    best = max(best, value[i] - chaining.GAP_COST * (p - q - n + s - t - n))
            value[j] = w + best
        chain = chaining.best_chains(runs)[0]
        got = sum(runs[r][3] for r in chain)
        for i, j in zip(chain, chain[1:]):
            got -= chaining.GAP_COST * (runs[j][0] - runs[i][0] - runs[i][2] + runs[j][1] - runs[i][1] - runs[i][2])
        assert got == pytest.approx(max(value))


def test_gap_alignment_is_shortest():
    rng = random.Random(2)
    for _ in range(80):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 7))] for _ in range(2))
        cost = {(0, 0): 0}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if i or j:
                    cost[i, j] = min(
                        cost.get((i - 1, j), 99) + 1, cost.get((i, j - 1), 99) + 1,
                        cost.get((i - 1, j - 1), 99) + (bool(i and j) and a[i - 1] != b[j - 1]),
                    )
        columns = chaining._gap_columns(np.array(a, np.int64), np.array(b, np.int64))
        assert [i for i, _ in columns if i >= 0] == list(range(len(a))) and [j for _, j in columns if j >= 0] == list(range(len(b)))
        assert sum(i < 0 or j < 0 or a[i] != b[j] for i, j in columns) == cost[len(a), len(b)]


def test_similar_parts_against_all_parts():
    """Every part that qualifies has its equal columns in a part given, whatever its sum is beside others."""
    rng = random.Random(7)
    cases = [([1] * 45 + [0] * 4 + [1] * 12, 50), ([1] * 3 + [0] + [1] * 44 + [0] + [1] * 3, 50), ([0, 1, 1, 1, 1], 5), ([1] * 48 + [0] * 2, 50), ([], 5), ([0] * 60, 50)]
    for _ in range(300):
        share = rng.choice([0.5, 0.75, 0.8, 0.9])
        cases.append(([int(rng.random() < share) for _ in range(rng.randint(0, 60))], rng.choice([3, 10, 20])))
    for equal, least in cases:
        got = chaining.similar_parts(np.array(equal, bool), least)
        assert all(b - a >= least and 5 * sum(equal[a:b]) >= 4 * (b - a) for a, b in got)
        assert not any(x != y and y[0] <= x[0] and x[1] <= y[1] for x in got for y in got)
        for a in range(len(equal)):
            for b in range(a + least, len(equal) + 1):
                if 5 * sum(equal[a:b]) >= 4 * (b - a):
                    ones = [i for i in range(a, b) if equal[i]]
                    assert any(x <= ones[0] and ones[-1] < y for x, y in got), (equal, least, a, b)


def test_fuzzy_passages(spark, awkward, nothing):
    rng = random.Random(9)
    passage = sentence(rng, 80).split(" ")
    changed = [*passage[:30], "new", "words", *passage[30:55], *passage[56:]]
    docs = [(1, sentence(rng, 20) + " " + " ".join(passage) + " " + sentence(rng, 20)), (2, sentence(rng, 33) + " " + " ".join(changed)), (3, sentence(rng, 200)), (4, " ".join(passage[:40]))]
    got = fuzzy_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["other_id"], r["start"], r["end"], r["other_start"], r["other_end"]) for r in got] == [(2, 1, 33, 114, 20, 100)]
    assert 0.9 < got[0]["similarity"] < 1
    found = defaultdict(list)
    for r in fuzzy_passages(awkward).collect():
        found[r["doc_id"]].append((r["start"], r["end"]))
    # Whatever repeats word for word in a smaller document lies in a passage found.
    for i, a, b in exact_passages([r for r in rows_of(awkward) if r[0] is not None and r[0] < 500], 50):
        assert i in (13, 17, 20) or any(x <= a and b <= y for x, y in found[i]), i
    assert fuzzy_passages(nothing).count() == 0


def test_fuzzy_passages_of_rows_that_ids_do_not_tell_apart(spark):
    """Rows without id and repeated ids neither hide what others share nor go unreported."""
    rng = random.Random(21)
    passage, other = sentence(rng, 80), sentence(rng, 70)
    pad = lambda: sentence(rng, 25)
    base = [(5, pad() + " " + passage), (9, passage + " " + pad())]

    def found(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        return sorted((r["doc_id"], r["other_id"], r["n_words"]) for r in fuzzy_passages(df).collect() if r["doc_id"] is not None)

    want = [(9, 5, 80)]
    assert found(base) == want
    alone = [(None, pad() + " " + passage + " " + pad()), (None, sentence(rng, 90))]
    assert found(base + alone) == want and found(base + alone[:1] * 2) == want
    rows = fuzzy_passages(spark.createDataFrame(base + alone, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["other_id"]) for r in rows) == [(0, 5), (0, 9), (9, 5)]
    # Two texts under one id: both are looked at, and both go by that id.
    twice = [(7, pad() + " " + other), (7, sentence(rng, 60)), (11, other + " " + pad()), (11, other + " " + pad())]
    # All three texts meet, whichever of 7 keeps its id as key.
    pairs = [(7, 11), (11, 7), (11, 11)]
    got = found(base + twice)
    assert got[0] in (want[0], (7, 11, 70)) and want[0] in got and len(got) == 4
    assert all(r == want[0] or (r[:2] in pairs and r[2] == 70) for r in got) and (11, 11, 70) in got


def test_fuzzy_passages_of_all_holders(spark):
    """A passage is found whoever else has its seeds; copies of a text are one document that meets all others."""
    rng = random.Random(33)
    w = [sentence(rng, 60).split(" ") for _ in range(3)]
    pad = lambda n: [f"p{rng.randrange(10**9)}" for _ in range(n)]
    both = w[0][:30] + w[1][:30]
    bent = w[2][:30] + ["new"] + w[2][30:]
    texts = [
        # The halves of what 5 and 9 share stand first in 1 and 2.
        (1, pad(30) + w[0][:30] + pad(30)), (2, pad(30) + w[1][:30] + pad(30)), (5, pad(40) + both + pad(9)), (9, both + pad(40)),
        # No run of forty words is left of what 12 and 14 share, and its halves stand first in 10 and 11.
        (10, w[2][:30] + pad(30)), (11, pad(30) + w[2][30:]), (12, pad(20) + w[2]), (14, pad(7) + bent + pad(20)),
        # In 16 the seeds stand first on their own, and only then the passage; 17 is 9 again.
        (16, both[:30] + pad(20) + both[30:] + pad(20) + both), (17, None),
    ]
    texts[-1] = (17, [x.upper() for x in texts[3][1]])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string").repartition(4)
    rows = fuzzy_passages(df).collect()
    assert {(r["doc_id"], r["other_id"]) for r in rows} == {(9, 5), (14, 12), (16, 5), (16, 9), (17, 9)}
    at = {(r["doc_id"], r["other_id"]): (r["start"], r["end"], r["other_start"], r["other_end"]) for r in rows}
    assert at[9, 5] == (0, 60, 40, 100) and at[14, 12] == (7, 68, 20, 80) and at[17, 9] == (0, 100, 0, 100)
    assert any(r["other_id"] == 9 and (r["start"], r["end"]) == (100, 160) for r in rows if r["doc_id"] == 16)


def test_hot_seeds_meet_in_parts(spark, monkeypatch):
    """Parts that meet two by two, and few pairs at a time, give the same passages."""
    rng = random.Random(5)
    line, pad = sentence(rng, 60), lambda: sentence(rng, 30)
    df = spark.createDataFrame([(i, pad() + " " + line + " " + pad()) for i in range(12)], "doc_id long, text string")
    want = sorted(fuzzy_passages(df).collect())
    assert len({(r["doc_id"], r["other_id"]) for r in want}) == 66
    monkeypatch.setattr(passage_dedup, "PART", 3)
    assert sorted(fuzzy_passages(df).collect()) == want


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    bad, dull = ["vile", "nasty", "awful", "rotten"], ["click", "here", "now", "buy"]
    docs, labels = [], []
    for i in range(600):
        toxic, low = rng.random() < 0.2, rng.random() < 0.3
        words = sentence(rng, rng.randint(5, 60)).split(" ") + rng.choices(bad, k=2) * toxic + rng.choices(dull, k=3) * low
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(not low), int(toxic)))
    return docs, labels


def test_chain_on_held_out_documents(spark, labelled):
    docs, labels = labelled
    df = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame([r for r in labels if r[0] < 400] + [(1, None, 1), (None, 1, 1), labels[2]], "doc_id long, quality int, toxic int")
    chain = tox.fit_chain(df, known, tox.label_categories())
    truth = {i: t for i, _, t in labels}
    got = {r["doc_id"]: r["rejected"] for r in tox.score_toxicity(df, chain, "toxic").collect()}
    held = [i for i in truth if i >= 400]
    assert np.mean([got[i] == bool(truth[i]) for i in held]) > 0.97
    assert len(chain.links[1].earlier) == 1 and len(chain.links[2].earlier) == 2
    assert {r["doc_id"] for r in tox.drop_toxic(df, chain, "toxic").collect()} == {i for i, bad in got.items() if not bad}


def test_chain_edges(spark, awkward, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = tox.fit_chain(awkward, none, tox.label_categories())
    got = tox.score_toxicity(awkward, chain, "toxic")
    assert got.count() == awkward.count() and got.filter("rejected").count() == 0
    assert tox.drop_toxic(awkward, chain, "toxic").columns == awkward.columns
    assert tox.score_toxicity(nothing, tox.fit_chain(nothing, none, tox.label_categories()), "toxic").count() == 0


def test_link_is_at_its_optimum():
    rng = np.random.default_rng(0)
    sizes = rng.integers(0, 6, 200)
    x = tox.Rows(np.concatenate([rng.choice(9, s, replace=False) for s in sizes]).astype(np.int64), sizes, 9)
    earlier, y = rng.normal(size=(200, 2)), (rng.random(200) < 0.4).astype(float)
    link = tox.fit_link(x, earlier, y)
    r = 1 / (1 + np.exp(-link.odds(x.dot(link.weights), earlier))) - y
    assert np.abs(x.dot_rows(r) + tox.RIDGE * link.weights).max() < 0.05 and abs(r.sum()) < 0.05
    assert np.abs(earlier.T @ r + tox.RIDGE * link.earlier).max() < 0.05


def test_clashing_columns_are_there(awkward):
    assert set(CLASHES) < set(awkward.columns)
    assert awkward.select(F.count("*")).first()[0] > 40
