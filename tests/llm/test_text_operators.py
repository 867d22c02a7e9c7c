"""Operators on whole texts against brute force, over nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from starloom.llm import _words as W
from starloom.llm import _shared, exact_dedup, language, packing
from starloom.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from starloom.llm.language import identify_languages, keep_identified, training_sample
from starloom.llm.mixing import mix_documents, mixed_corpus
from starloom.llm.near_dedup import drop_near_duplicates, near_duplicates
from starloom.llm.substring_dedup import remove_repeated_substrings
from starloom.llm.suffix_dedup import remove_repeated_passages, repeated_passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENS = public_tokenizers.path("byte_bpe_50k.json")
#: A column that clashes with every name the operators use within.
COLUMNS = "doc_id long, text string, source string, lang string, TAG string, cls string, band string, row string"


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = words(70)
    texts = [None, "", " \t\n", "one", "One two", "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a", " ".join(words(9000)), "é ß 12 …"]
    for i in range(60):
        own = words(rng.randint(5, 120))
        if i % 3 == 0:
            at = rng.randint(0, len(own))
            part = shared[rng.randint(0, 20) : rng.randint(34, 70)]
            own = own[:at] + part + own[at:]
        texts.append(rng.choice([" ", "\n", "  "]).join(own))
    for i in range(25):
        own = (texts[8 + i % 7] or "").split()
        if i % 2 and own:
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts.append(" ".join(own) + rng.choice(["", " ", "\t"]))
    rows = [(i, t, f"s{i % 4}" if i % 9 else None, "xx" if i % 2 else None, "t", "c", "b", "r") for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (20, "another text under an id that is taken", "s0", None, None, None, None, None), (None, texts[10], None, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


def words_of(text, lower=False):
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_words_and_minimisers():
    texts = [x[1] for x in corpus()]
    found = W.split_words(pa.array(texts))
    flat = [w for t in texts for w in words_of(t)]
    assert [found.data[a:b].tobytes().decode() for a, b in zip(found.starts, found.ends)] == flat
    assert len(set(zip(flat, found.hashes.tolist()))) == len(set(flat)) == len(set(found.hashes.tolist()))
    for length in (1, 3, 13, 50):
        whole = np.flatnonzero(W.starts_of_windows(found.offsets, length))
        pairs = {(tuple(flat[i : i + length]), int(h)) for i, h in zip(whole, W.phrases(found.hashes, length)[whole])}
        assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})
    h, chosen = W.phrases(found.hashes, 7), set()
    for a, b in zip(found.offsets[:-1], found.offsets[1:]):
        for s in range(a, b - 12):
            chosen |= {i for i in range(s, s + 7) if h[i] == h[s : s + 7].min()}
    assert set(W.minimisers(found, 7, 7)[0].tolist()) == chosen


def test_hashes_do_not_depend_on_place():
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    assert (W.split_words(pa.array([long])).hashes == W.split_words(pa.array(["x y", long])).hashes[2:]).all()


def tag_of(text):
    """The order of texts that share an id: the low 31 bits of Spark's xxHash64."""
    return xxhash.xxh64_intdigest((text or "").encode(), seed=42) & 0x7FFFFFFF


def repeated_words(rows, window, inside):
    first = {}
    for i, text in sorted({(i, t or "") for i, t, *_ in rows if i is not None}):
        own, tag = words_of(text), tag_of(text)
        for s in range(len(own) - window + 1):
            key = tuple(own[s : s + window])
            first[key] = min(first.get(key, (i, tag, s)), (i, tag, s))

    def gone(i, text):
        own, out, tag = words_of(text), set(), tag_of(text)
        if i is not None:
            for s in range(len(own) - window + 1):
                at = first[tuple(own[s : s + window])]
                if at[0] < i or (inside and at < (i, tag, s)):
                    out |= set(range(s, s + window))
        return own, out
    return gone


@pytest.mark.parametrize(("window", "small_tasks"), [(13, 0), (6, 0), (13, 3)], indirect=["small_tasks"])
def test_substring_dedup(docs, window, small_tasks):
    gone = repeated_words(corpus(), window, False)
    expected = Counter()
    for i, text, *_ in corpus():
        own, out = gone(i, text)
        kept = " ".join(w for k, w in enumerate(own) if k not in out)
        expected[i, len(own), len(out), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    assert rows_of(remove_repeated_substrings(docs, window=window, with_text=True)) == expected


@pytest.fixture
def small_tasks(request, monkeypatch):
    """Limits so low that phrases and blocks are dealt to several tasks, and texts to several pieces."""
    from starloom.llm import substring_dedup, suffix_dedup

    if request.param:
        for module, names in ((suffix_dedup, ("PHRASE_ROWS", "TASK_ROWS")), (substring_dedup, ("TASK_PHRASES", "PIECE_WORDS", "INDEX_WORDS"))):
            for name in names:
                monkeypatch.setattr(module, name, request.param)


@pytest.mark.parametrize(("window", "small_tasks"), [(20, 0), (12, 0), (20, 3)], indirect=["small_tasks"])
def test_suffix_dedup(docs, window, small_tasks):
    rows = corpus()
    gone = repeated_words(rows, window, True)
    spans, texts = Counter(), Counter()
    for i, text, *_ in rows:
        own, out = gone(i, text)
        texts[i, " ".join(w for k, w in enumerate(own) if k not in out)] += 1
        for s in sorted(out):
            if s - 1 not in out:
                n = next(k for k in range(1, len(own) + 2) if s + k not in out)
                spans[i, s, n, len(own)] += 1
    assert rows_of(repeated_passages(docs, words=window)) == spans
    assert rows_of(remove_repeated_passages(docs, words=window)) == texts


def test_suffix_array_at_random():
    """Chains break where phrases do not touch, and reach as far as asked."""
    from starloom.llm.suffix_dedup import chains

    keys, gaps, joint = np.arange(1, 7, dtype=np.uint64), np.array([3, 3, 9, 3, 3]), np.array([True, True, False, True, True])
    h, far = chains(keys, gaps, joint, 6)
    assert far.tolist() == [True, False, False, True, False, False] and h[0] != h[3]


def test_index_finds_the_longest_factor():
    from starloom.llm.substring_dedup import Index, greedy_factors

    rng = np.random.default_rng(2)
    for top in (2, 4, 30):
        known, asked = rng.integers(0, top, 60), rng.integers(0, top, 50)
        tokens = np.concatenate([known, [1000], asked, [1001]])
        marks = np.arange(len(tokens)) < 60
        got = Index(tokens, 61).longest(np.arange(61, 111), marks)
        text = lambda x: "".join(chr(65 + v) for v in x)
        best = [max(n for n in range(51 - i) if text(asked[i : i + n]) in text(known)) for i in range(50)]
        assert got.tolist() == best
        at = 0
        for s, n in greedy_factors(got, 0, 50, 1):
            assert s >= at and n == best[s]
            at = s + n


def shingles(text, length):
    own = words_of(text, lower=True)
    return {tuple(own[i : i + length]) for i in range(len(own) - length + 1)} if len(own) >= length else {tuple(own)} if own else set()


def near_groups(rows, percent):
    sets = [(i, shingles(t, 5)) for i, t, *_ in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        ids[find(k)].append(i)
    least = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return [(i, len(s), least[find(k)] if s else i) for k, (i, s) in enumerate(sets)]


@pytest.mark.parametrize("percent", [85, 60])
def test_near_duplicates(docs, percent):
    expected = Counter((i, n, c, i == c) for i, n, c in near_groups(corpus(), percent))
    assert rows_of(near_duplicates(docs, percent=percent)) == expected


def test_large_near_group(spark):
    """Many near copies, most of which are not near one another, stay one component as by brute force."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(120):
        own = list(base)
        for k in rng.sample(range(150), rng.randint(0, 4)):
            own[k] = f"x{rng.randrange(9000)}"
        rows.append((i, " ".join(own)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85)
    assert rows_of(got) == Counter((i, n, c, i == c) for i, n, c in near_groups(rows, 85))


def test_drop_near_duplicates(docs):
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept) == Counter(r for r, (i, _, c) in zip(corpus(), near_groups(corpus(), 80)) if i == c)


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_exact_duplicates(docs, monkeypatch, bound):
    """With the filter broadcast, and joined by slice."""
    monkeypatch.setattr(_shared, "BROADCAST_BYTES", bound)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, *_ in corpus():
        groups[norm(t)].append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    expected = Counter((i, least[norm(t)], len(groups[norm(t)]), i == least[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in corpus())
    assert rows_of(exact_duplicates(docs)) == expected
    assert rows_of(drop_exact_duplicates(docs)) == Counter(r for r in corpus() if r[0] == least[norm(r[1])])


def test_bloom_filter_at_any_load(spark):
    """All repeats are found; the others by chance: about (1 - exp(-2 / bits a row)) ** 2 of them."""
    rows = spark.range(40_000).selectExpr("xxhash64(id) h").union(spark.range(500).selectExpr("xxhash64(id) h"))
    for told in (40_500, 40_500 // 8):
        filter_, slices = exact_dedup.bloom_filter(rows, told, True)
        found = exact_dedup.probed(rows.distinct(), "h", filter_, slices, "maybe").where("maybe")
        assert found.join(spark.range(500).selectExpr("xxhash64(id) h"), "h").count() == 500
        chance = (1 - np.exp(-2 * 40_500 / (slices << 15))) ** 2
        assert 0.7 * chance <= (found.count() - 500) / 39_500 <= 1.3 * chance + 0.01


def test_encoding_is_that_of_the_tokenizer():
    exact = Tokenizer.from_file(TOKENS)
    marks = [chr(c) for c in [*range(0x3000), 0x3000, 0x4E2D, 0x1F600, 0xFEFF]]
    texts = [f"a{c}b {c} 1{c}2{c}{c}\n{c}'s" for c in marks] + ["<|endoftext|> x<|endoftext|>", "  \n\n x  ", "don't WE'LL", "a" * 3000, " " * 3000, ""]
    for text in texts:
        assert packing.encode(text, TOKENS).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_encoding_on_both_sides_of_the_long_bound(monkeypatch):
    """What the fast library gives for long texts is what the tokenizer gives."""
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdeéλж’1") for _ in range(rng.randint(1, 9))) for _ in range(20_000))
    exact = Tokenizer.from_file(TOKENS).encode(text, add_special_tokens=False).ids
    for bound in (len(text), len(text) + 1):
        monkeypatch.setattr(packing, "_LONG", bound)
        assert packing.encode(text, TOKENS).tolist() == exact


def test_packing_bounds():
    rng = np.random.default_rng(4)
    for _ in range(60):
        sizes = rng.integers(1, 16, rng.integers(1, 8))
        bins, offsets = packing.best_fit_decreasing(sizes, 16)
        best = fewest(sizes.tolist(), 16)
        assert packing.lower_bound(sizes, 16) <= best <= bins.max() + 1
        assert np.bincount(bins, weights=sizes).max() <= 16


def fewest(sizes, capacity):
    best = len(sizes)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity:
                bins[j] += sizes[i]
                put(i + 1, bins)
                bins[j] -= sizes[i]
        put(i + 1, [*bins, sizes[i]])

    best += 1
    put(0, [])
    return best


@pytest.mark.parametrize("group_rows", [100_000, 12])
def test_packing_round_trip(docs, group_rows):
    capacity = 64
    exact = Tokenizer.from_file(TOKENS)
    rows = packing.pack_documents(docs, TOKENS, capacity=capacity, group_rows=group_rows, with_ids=True).collect()
    expected = Counter()
    for i, t, *_ in corpus():
        ids = exact.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            expected[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *[n for _, n in parts[:-1]]]))
        assert sum(n for _, n in parts) <= capacity
    sizes = np.array([r.length for r in rows])
    slack = 1 if group_rows > 1000 else 3
    assert len(bins) <= packing.lower_bound(sizes, capacity) + slack


def test_mixing(docs):
    count = Counter()
    for i, t, s, *_ in corpus():
        count[s] += len(words_of(t))
    total, weights = sum(count.values()), {}
    for k, s in enumerate(sorted(count, key=lambda x: (x is None, x or ""))):
        weights[s] = k % 3 + 1
    target, open_ = {}, set(count)
    while True:
        level = (total - sum(target.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 3 * count[s]}
        if not over:
            break
        target |= {s: 3 * count[s] for s in over}
        open_ -= over
    target |= {s: level * weights[s] for s in open_}
    rows = mix_documents(docs).collect()
    assert rows_of(mix_documents(docs)) == Counter(map(tuple, rows))
    ids = {(i, len(words_of(t))): s for i, t, s, *_ in corpus()}
    taken, largest = Counter(), Counter()
    for r in rows:
        s = ids[r.doc_id, r.size]
        assert (r.source_size, r.target) == (count[s], pytest.approx(target[s]))
        assert r.taken in [r.size * k for k in range(4)]
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in count)
    mixed = Counter((r.doc_id, r.text) for r in mixed_corpus(docs).collect())
    assert sum(n * len(words_of(t)) for (_, t), n in mixed.items()) == sum(taken.values())


def test_texts_are_counted_once(docs):
    """The mix of whole rows evaluates the pattern of words once a text: no filter or further column repeats it."""
    plan = mixed_corpus(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_mixing_with_document_weights(spark):
    rows = [(i, "w " * (i % 7 + 1), "s", float(i % 3)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    got = {r.doc_id: r for r in mix_documents(docs, weight_col="q").collect()}
    assert all(got[i].taken == 0 for i in range(0, 300, 3))
    assert abs(sum(r.taken for r in got.values()) - got[0].target) <= 7


def test_languages_with_long_texts_only(spark):
    words = {"aa": "kalo mira tuse", "bb": "zwig pfron schrut"}
    rows = [(i, f"{words['aa']} " * 4, "aa") for i in range(40)] + [(100 + i, f"{words['bb']} " * 40, "bb") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify_languages(docs, sample_rows=20, sample_chars=100).collect()
    assert all(r.lang_pred == ("aa" if r.doc_id < 100 else "bb") for r in got)
    assert {r.lang for r in keep_identified(docs, sample_rows=20, sample_chars=100).select("lang").distinct().collect()} == {"aa", "bb"}
    one = docs.where("doc_id < 41 or doc_id = 100").selectExpr("doc_id + 1 doc_id", "text", "lang")
    assert {r.lang for r in training_sample(one, "doc_id", "text", "lang", 20, 100).collect()} == {"aa", "bb"}
    many = [tuple(r) for r in training_sample(docs, "doc_id", "text", "lang", 20, 20).collect()]
    assert sum(len(t) for lang, t in many if lang == "bb") <= (32 + 8) * 20 and max(len(t) for _, t in many) <= 8 * 20


def test_language(spark):
    rng = random.Random(2)
    kinds = {"aa": "bcdfg", "bb": "pqrst", "cc": "vwxyz"}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(4)) for _ in range(30)), k) for i, k in enumerate(list(kinds) * 60)]
    extra = [(1000, None, None), (1001, "12 ... €", "aa"), (1002, "é", None), (None, rows[0][1], "bb"), (1003, "x" * 100_000, None)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify_languages(docs, sample_rows=20).collect()}
    for i, _, k in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].lang_pred == k and 0 <= got[i].score <= 1
    assert (got[1000].lang_pred, got[1001].lang_pred, got[1000].score) == ("und", "und", 0.0)
    assert got[1002].lang_pred in kinds and got[None].lang_pred == "aa" and got[None].held_out is False
    kept = Counter(r.doc_id for r in keep_identified(docs, sample_rows=20).collect())
    assert kept == Counter([*[r[0] for r in rows], None]) | Counter(x for x in (1003,) if kept[x])
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in identify_languages(unlabelled).collect()} == {"und"}


def test_held_out_accuracy(spark):
    """Languages of the test table's held-out quarter, whatever the sources; clean documents have a language."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = {r.doc_id: r.lang for r in docs.where("lang is not null").collect()}
    got = [r for r in identify_languages(docs).collect() if r.held_out and r.doc_id in known]
    right = sum(r.lang_pred == known[r.doc_id] for r in got)
    assert len(got) > 100 and right >= 0.95 * len(got), (right, len(got))


def test_filters_by_brute_force(spark):
    """Held n-grams are those of the definition, and corrected rates come near the shares that sets give."""
    rng = random.Random(11)
    kinds = {"aa": "abcdef", "bb": "cdefgh", "cc": "efghij"}
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randint(2, 6))) for _ in range(150)] for k, v in kinds.items()}
    texts = [(k, " ".join(rng.choice(words[k]) for _ in range(60))) for k in kinds for _ in range(25)]

    counts = {k: Counter(int.from_bytes(g, "big") for own, t in texts if own == k for g in grams_of(t)) for k in kinds}
    rate = {k: {g: n / c.total() for g, n in c.items()} for k, c in counts.items()}
    held = {k: {g for g, n in c.items() if n >= 2 and rate[k][g] >= 0.2 * max(r.get(g, 0) for r in rate.values())} for k, c in counts.items()}
    filters = language.fit(spark.createDataFrame(texts, "lang string, text string"), bits=14)
    assert filters.languages == tuple(kinds)
    expected = language.filters_of(tuple(kinds), [np.array(sorted(held[k]), np.uint32) for k in kinds], 14)
    assert (filters.masks == expected.masks).all() and (filters.false == expected.false).all()
    for k, text in texts[::7]:
        own = [int.from_bytes(g, "big") for g in grams_of(text)]
        shares = {x: sum(g in held[x] for g in own) / len(own) for x in kinds}
        langs, scores = language._rates(filters, [text])
        assert langs == [max(shares, key=shares.get)] == [k] and abs(scores[0] - shares[k]) < 0.05


def grams_of(text):
    """Runs of four folded bytes of a text with one space before and two behind, blank ones left out."""
    raw = " " + "".join(c.lower() if c.isascii() and c.isalpha() else c if not c.isascii() else " " for c in text) + "  "
    raw = raw.encode()
    return [raw[i : i + 4] for i in range(len(raw) - 3) if raw[i : i + 4] != b"    "]


def test_repeated_rows_and_clashing_columns_of_languages(spark):
    rows = [(i % 40, f"{'kalo mira tuse' if i % 2 else 'zwig pfron schrut'} " * 5, "a" if i % 2 else "b", "x", "y") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out string, Score string")
    got = Counter(map(tuple, identify_languages(docs).collect()))
    assert sum(got.values()) == 80 and set(got.values()) == {2} and all(g[2] == ("a" if g[0] % 2 else "b") for g in got)
    assert keep_identified(docs).columns == docs.columns and keep_identified(docs).count() == 80


def test_empty_tables(empty):
    for f in (near_duplicates, exact_duplicates, remove_repeated_substrings, repeated_passages, mix_documents, identify_languages):
        assert f(empty).collect() == []
    assert packing.pack_documents(empty, TOKENS).collect() == []
    for f in (drop_near_duplicates, drop_exact_duplicates, mixed_corpus, keep_identified):
        out = f(empty)
        assert out.collect() == [] and out.columns == empty.columns


@pytest.mark.parametrize("limits", [(256, 1 << 20), (7, 1 << 20), (256, 500)])
def test_clusters_of_any_size(spark, monkeypatch, limits):
    """A cluster in one tile, in many small ones, and cut by its shingles: the same components, as by brute force."""
    from starloom.llm import near_dedup

    monkeypatch.setattr(near_dedup, "TILE", limits[0])
    monkeypatch.setattr(near_dedup, "TILE_SHINGLES", limits[1])
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(90):
        own = list(base)
        for k in rng.sample(range(120), rng.randint(0, 5)):
            own[k] = f"x{rng.randrange(9000)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = Counter((i, n, c, i == c) for i, n, c in near_groups(rows, 85))
    assert len({x[2] for x in expected}) > 2
    assert rows_of(near_duplicates(docs)) == expected


def test_shared_sizes():
    from starloom.llm.near_dedup import shared

    rng = np.random.default_rng(1)
    left, right = ([np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in sizes] for sizes in ((5, 6000, 1), (7000, 3)))
    assert shared(left, right).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]
