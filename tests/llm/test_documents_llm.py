"""Every operator on documents against a brute-force version, over the awkward cases."""
import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from docsift.llm import bpe, language, toxicity
from docsift.llm.neardup import REGISTERS, estimate, near_duplicates, reaches, sketch
from docsift.llm.packing import pack, plan
from docsift.llm.repeats import levels_from, remove_repeats
from docsift.llm.sharding import kd_shards

from .fixtures_llm import docs_df, documents, row, sentence, words


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_df(spark, rows).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs_df(spark, [])


# --- sharding

def test_shards_are_even_and_slots_gapless(docs, rows):
    got = kd_shards(docs, 8).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in rows)
    for s, slots in _by(got, "shard", "slot").items():
        assert 0 <= s < 8 and sorted(slots) == list(range(len(slots)))


def test_shard_bytes_are_nearly_equal(spark):
    many = docs_df(spark, [row(i, "a" * (i % 50) if i % 3 else "hot copy") for i in range(4000)])
    size = Counter()
    for r in kd_shards(many, 8).collect():
        size[r.shard] += r.size
    assert len(size) == 8 and max(size.values()) <= 1.02 * min(size.values())


def test_shards_of_nothing(empty):
    assert kd_shards(empty, 8).collect() == []


def _by(rows, key, value):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r[value])
    return out


# --- packing

def test_packed_pieces_hold_every_id_once(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    window = 256
    got = pack(docs, path, window).collect()
    want = Counter()
    for d in rows:
        ids = tok.encode(d[1] or "", add_special_tokens=False).ids + [1]
        want[(d[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    ids_of = defaultdict(list)
    for d in rows:
        ids_of[d[0]].append(tok.encode(d[1] or "", add_special_tokens=False).ids + [1])
    assert sum(r.length for r in got) == sum(k[1] * c for k, c in want.items())
    for r in got:
        pieces = [np.array(x[r.start:r.start + r.length], "<u4") for x in ids_of[r.doc_id] if len(x) == r.doc_tokens]
        assert r.ids_crc32 in {zlib.crc32(p.tobytes()) for p in pieces}
    for s in _by(got, "sequence_id", "offset"):
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    assert sorted(set(r.sequence_id for r in got)) == list(range(len({r.sequence_id for r in got})))


@pytest.mark.parametrize("histogram", [
    {1500: 1000}, {100: 1}, {2048: 5, 7: 3}, {1025: 100, 1024: 3, 1: 5}, {1999: 50, 60: 7, 2048: 1},
    {n: 3 for n in range(1, 2048, 5)}, {}])
def test_plan_uses_every_piece_once(histogram):
    rows = plan(dict(histogram), 2048).rows
    used, full = defaultdict(Counter), defaultdict(list)
    for i in range(len(rows["low"])):
        length, cut, tail = rows["length"][i], rows["cut"][i], rows["tail"][i]
        for number in range(rows["low"][i], rows["high"][i]):
            slot = rows["slot"][i] + number - rows["low"][i]
            used[length][(number, cut, tail)] += 1
            full[rows["sequence"][i] + slot // rows["per"][i]].append(
                (rows["offset"][i] + slot % rows["per"][i] * rows["size"][i], rows["size"][i]))
    for length, n in histogram.items():
        numbers = defaultdict(set)
        for (number, cut, tail), k in used[length].items():
            assert k == 1
            numbers[number].add((cut, tail))
        assert sorted(numbers) == list(range(n))
        assert all(v == {(0, 0)} or {t for _, t in v} == {0, 1} and len({c for c, _ in v}) == 1 for v in numbers.values())
    for v in full.values():
        at = 0
        for offset, size in sorted(v):
            assert offset == at
            at += size
        assert at <= 2048


def test_added_tokens_have_their_ids(spark):
    """Against the library with its default settings."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "<|endoftext| >", "no such token"]
    want = {i: tok.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    assert want[0][:-1] == [31373, 220, 50256, 995]
    got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in pack(docs_df(spark, [row(*t) for t in enumerate(texts)]), path).collect()}
    assert got == {i: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in want.items()}


def test_new_matches_go_through_the_model_together():
    """One call for the new matches of a group, none for those known; forgetting changes no ids."""
    from docsift.llm.tokens import PieceIds
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(4)
    texts = ["", "a \xff\u0100\xa0\x85 \u65e5\u672c\U0001f600\x00 z", "x" * 300, "<|endoftext|> after", " \n\n\t", "it's 12345 -- !"]
    texts += [" ".join("".join(rng.choices("etaoinéß漢", k=rng.randint(3, 12))) for _ in range(40)) for _ in range(60)]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]

    class Calls:
        def __init__(self, of):
            self.of, self.n = of, 0

        def encode(self, *args, **kwargs):
            self.n += 1
            return self.of.encode(*args, **kwargs)

    ids = PieceIds(path)
    calls = ids.words = Calls(ids.words)
    assert list(ids.each(texts)) == want and calls.n == 1
    assert list(ids.each(texts)) == want and calls.n == 1
    ids.GROUP, ids.BYTES = 100, 10_000
    ids._forget()
    assert list(ids.each(texts)) == want and len(ids) < 100


def test_checksum_of_a_rest():
    from docsift.llm.packing import _rest
    data = bytes(range(256)) * 33
    for cut in (0, 1, 256, 4000, len(data)):
        assert _rest(zlib.crc32(data), zlib.crc32(data[:cut]), len(data) - cut) == zlib.crc32(data[cut:])


def test_pack_nothing(empty):
    assert pack(empty, public_tokenizers.path("byte_bpe_50k.json")).collect() == []


# --- byte-level BPE

@pytest.fixture(scope="module")
def encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as fh:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, fh)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(docs, rows, empty, encoding):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    got = Counter(tuple(r) for r in bpe.round_trip(docs, path, pattern).collect())
    want = Counter()
    for d in rows:
        ids = encoding.encode_ordinary(d[1] or "")
        want[(d[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
              hashlib.sha256((d[1] or "").encode()).hexdigest())] += 1
    assert got == want
    back = bpe.decode(bpe.encode(docs.where("doc_id = 407"), path, pattern), path, pattern).first()
    assert bytes(back["bytes"]).decode() == next(d[1] for d in rows if d[0] == 407)
    assert bpe.round_trip(empty, path, pattern).collect() == []


def test_bpe_of_odd_strings(encoding):
    import random
    rng = random.Random(4)
    b = bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = ["".join(rng.choice("abcdeéЖ漢\U0001F600 '\n\t!0") for _ in range(rng.randrange(200))) for _ in range(500)]
    texts += ["a" * 3000, "ab" * 2000, " " * 2000, "".join(rng.choice("etaoin") for _ in range(5000)), "<|endoftext|>"]
    for t in texts:
        ids = [i for ids in b.encode_pieces([p.encode() for p in b.split(t)]) for i in ids]
        assert ids == encoding.encode_ordinary(t) and b.decode(ids) == t.encode()


# --- language and toxicity

def test_language(spark, empty):
    import random
    rng = random.Random(2)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ter"], "cc": ["eau", "oi", "ré"]}
    rows = [row(i, " ".join("".join(rng.choice(parts[g]) for _ in range(3)) for _ in range(20)), g)
            for i, g in enumerate(rng.choice(list(parts)) for _ in range(240))]
    model = language.train(docs_df(spark, rows + [row(900, "no label", None), row(901, None, "aa"), row(902, "", "bb")]))
    odd = [row(903, None), row(904, "12 ?!"), row(905, ""), row(None, "kalomi kaka"), row(906, "Ж")]
    got = language.predict(docs_df(spark, rows + odd), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert sum(by[d[0]].lang_pred == d[2] for d in rows) >= 0.98 * len(rows)
    assert all(by[i].lang_pred == "und" and by[i].rejected for i in (903, 904, 905))
    assert by[906].lang_pred in parts and all(0 <= r.score <= 1 for r in got)
    none = language.train(empty)
    assert language.predict(empty, none).collect() == []
    assert {r.lang_pred for r in language.predict(docs_df(spark, odd), none).collect()} == {"und"}


def test_toxicity(spark, empty):
    import random
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = sentence(rng, 40).split()
        if toxic:
            w.insert(rng.randrange(40), rng.choice(["Vile!", "nasty,", "VILE"]))
        rows.append(row(i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    labels += [(500, 1, 1), (1, 0, None), (0, 1, 1)]  # no such document; no label; a repeated row
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = docs_df(spark, rows)
    known = toxicity.known_labels(table)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in known.select("doc_id").collect())
    model = toxicity.train(docs, known)
    assert len(model["idx"]) < 2000  # sparse
    got = toxicity.score(docs_df(spark, rows + [row(600, None), row(601, ""), row(None, "x vile")]), model).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got) and len(got) == 403
    nothing = toxicity.train(empty, known)
    assert toxicity.score(empty, nothing).collect() == []
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.5}


# --- near-duplicates

def _sets(rows, k):
    out = {}
    for d in rows:
        w = words((d[1] or "").translate({c: c + 32 for c in range(65, 91)}))
        s = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        out.setdefault(d[0], []).append(s)
    return out


def _brute_components(rows, k):
    sets = [(i, s) for i, many in _sets([d for d in rows if d[0] is not None], k).items() for s in many]
    low = {i: i for i, _ in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i
    for a, x in sets:
        for b, y in sets:
            if a > b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(a), root(b)
                low[max(p, q)] = min(p, q)
    return {i: root(i) for i in low}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(docs, rows, k):
    got = near_duplicates(docs, k, 80).collect()
    want = _brute_components(rows, k)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        assert r.n_shingles in {len(s) for s in _sets(rows, k)[r.doc_id]}
        assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_duplicate_chain_without_the_smallest(spark):
    """Members of a bucket that its smallest member doesn't link are still compared."""
    import random
    rng = random.Random(8)
    base = sentence(rng, 200, 10_000).split()
    rows = []
    for i in range(40):  # a chain: each differs from the one before in a few words
        for _ in range(3):
            base[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
        rows.append(row(i, " ".join(base)))
    rng.shuffle(rows)
    got = near_duplicates(docs_df(spark, rows), 2, 80).collect()
    want = _brute_components(rows, 2)
    assert {r.doc_id: r.component_id for r in got} == want


def test_reaches_holds_wherever_the_estimate_does():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 255, (20_000, REGISTERS)).astype(np.uint8)
    other = np.where(rng.random(base.shape) < rng.random((len(base), 1)), base, rng.integers(0, 255, base.shape)).astype(np.uint8)
    nx = rng.integers(1, 5000, len(base)).astype(float)
    ny = np.ceil(nx * rng.uniform(0.8, 1, len(base)))
    j, least = estimate(base, other, nx, ny), 0.65
    got = reaches(base, other, nx, ny, least)
    assert (j >= least).any() and (j < least).any()
    assert got[j >= least + 1e-4].all()
    assert not got[j < least - 0.002].any()
    assert reaches(base, other, nx, ny, -0.1).all()


def test_near_duplicates_of_nothing(empty):
    assert near_duplicates(empty).collect() == []


def test_estimate_follows_the_similarity():
    rng = np.random.default_rng(1)
    for j in (0.3, 0.8, 0.95):
        errors = []
        for _ in range(20):
            n = 1000
            both = round(2 * n * j / (1 + j))
            all_ = np.unique(rng.integers(0, 1 << 63, 3 * n).astype(np.uint64) * np.uint64(2))
            rng.shuffle(all_)
            x, y = all_[:n], np.concatenate([all_[:both], all_[n:2 * n - both]])
            s = [np.frombuffer(sketch(v), np.uint8)[None] for v in (x, y)]
            errors.append(estimate(*s, np.array([float(n)]), np.array([float(n)]))[0] - both / (2 * n - both))
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.15
    assert len(sketch(np.array([7], np.uint64))) == REGISTERS


# --- substring dedup

def _brute_repeats(rows, window):
    first = {}
    for d in rows:
        w = words(d[1])
        for i in range(len(w) - window + 1 if d[0] is not None else 0):
            key = tuple(w[i:i + window])
            first[key] = min(first.get(key, d[0]), d[0])
    out = Counter()
    for d in rows:
        w = words(d[1])
        gone = [False] * len(w)
        for i in range(len(w) - window + 1 if d[0] is not None else 0):
            if first[tuple(w[i:i + window])] < d[0]:
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[(d[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("window,start", [(13, 7), (50, 13), (3, 3)])
def test_repeats_equal_brute_force(docs, rows, window, start):
    got = remove_repeats(docs, window, start, digest=True)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == _brute_repeats(rows, window)


def test_repeats_keep_columns_and_white_space(docs, rows, empty):
    out = remove_repeats(docs, 50, 25)
    assert out.columns == [*docs.columns, "n_words", "n_removed"]
    got = {r.doc_id: r for r in out.where("doc_id >= 300 and doc_id < 304 or doc_id = 400").collect()}
    source = {d[0]: d[1] for d in rows}
    assert got[300].text == source[300] and got[400].text is None and got[400].n_removed == 0
    for i in (301, 302, 303):
        w = words(source[i])
        assert words(got[i].text) == w[:21] + w[81:] and got[i].n_removed == 60
        assert got[i].text.startswith(source[i].split("\n")[0] + "\n")
    assert remove_repeats(empty, 13, 7, digest=True).collect() == []
    assert remove_repeats(empty, 13, 7).collect() == []


@pytest.mark.parametrize("start", [25, 13])
def test_repeats_in_chunks_of_few_words(spark, start):
    """Every row a chunk of its own, of every number of words around the window's."""
    import random
    rng = random.Random(12)
    base = sentence(rng, 60, 10_000).split()
    rows = [row(n, " ".join(base[:n])) for n in range(61)] + [row(100 + n, sentence(rng, n, 10_000)) for n in range(61)]
    table = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), docs_df(spark, []).schema)
    got = remove_repeats(table, 50, start, digest=True).collect()
    want = _brute_repeats(rows, 50)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(k[2] for k in want) == sum(range(50, 60))  # 51 to 60 words: the words a shorter row's windows cover


def test_levels_double():
    assert levels_from(7, 13) == [7, 13] and levels_from(13, 50) == [13, 26, 50] and levels_from(20, 13) == [13]
