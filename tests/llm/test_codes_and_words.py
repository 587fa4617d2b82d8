"""Spelling variants, vector codes and sentence pieces against brute force, and their edge cases."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import sentence_pieces, spelling_variants, vector_codes

public_tokenizers = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, source string, word string, n long, run string, ids string, h long, base int, block int, decoded string"


def documents(spark, rows):
    """Rows of (doc_id, text); the other columns have names that operators use inside."""
    return spark.createDataFrame([(i, t, "s", "w", 1, "r", "i", 2, 3, 4, "d") for i, t in rows], DOCS)


# spelling variants


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(n):
    out = {}
    for w in n:
        around = [v for v in n if near(w, v)]
        best = min(around, key=lambda v: (-n[v], v), default=None)
        out[w] = (n[w], len(around), best if best and n[best] >= 5 * n[w] else None)
    root = lambda w: w if out[w][2] is None else root(out[w][2])
    return {(w, f, root(w), k, m, n[f] if f else None) for w, (k, m, f) in out.items()}


def brute_variants(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return brute_forms({w: k for w, k in n.items() if len(w) >= 6 and k >= 5})


def variants(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.spelling_variants(df).collect()}


def test_spelling_variants(spark):
    r = random.Random(3)
    stems = ["".join(r.choice("abÉéßzÿ×") for _ in range(r.randrange(6, 9))) for _ in range(12)]
    words = []
    for s in stems:
        for _ in range(25):
            at, how, letter = r.randrange(len(s)), r.randrange(4), r.choice("abQz")
            words.append(s if how == 0 else s[:at] + letter * (how != 2) + s[at + (how != 1) :])
    pool = [w for w in words for _ in range(int(r.paretovariate(0.5)) % 300 + 1)]
    rows = [(i, " ".join(r.choice(pool) for _ in range(400)) + "-x1 漢字") for i in range(30)]
    rows += [(None, "NoIdNo " * 9), (3, None), (4, ""), (5, " \n\t"), (6, "a" * 100_000), (7, "same7same " * 6), (7, "same7same " * 6), (8, "twice " * 5), (8, "twicex " * 5), (9, ("Zebraé Zebraè " * 500)[:-1])]
    want = brute_variants(rows)
    assert variants(documents(spark, rows)) == want
    assert len(want) > 100 and sum(f is not None for _, f, *_ in want) > 20 and any(f not in (None, root) for _, f, root, *_ in want)


def test_spelling_variants_of_nothing(spark):
    assert variants(documents(spark, [])) == set()
    assert variants(documents(spark, [(1, None), (2, ""), (3, "short")])) == set()


def test_a_family_larger_than_a_block_is_whole(spark):
    """All words share all but two letters, so that one family holds a third of all rows and more."""
    r = random.Random(4)
    n = {"abcd" + "".join(r.choice("xyzuvw") for _ in range(r.choice((2, 3)))) + "efgh": r.randrange(5, 9000) for _ in range(150)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {(x.word, x.near, x.near_n) for x in spelling_variants.near_words(words, block=7).collect()}
    assert got == {(a, b, n[b]) for a in n for b in n if near(a, b)}
    assert spelling_variants.near_words(words, block=7).count() == len(got)


def test_forms_lead_to_the_last_one(spark):
    chain = {"abcdef"[:k] + "ghijkl"[k:]: 5 * 6**k for k in range(7)}
    got = {r.word: (r.form, r.root) for r in spelling_variants.forms(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()}
    words = list(chain)
    assert got == {w: (words[k + 1] if k < 6 else None, words[-1]) for k, w in enumerate(words)}


# vector codes


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 40), st.integers(1, 12), st.integers(1, 12), st.sampled_from([1, 9, 20, 27]), st.integers(0, 1000))
def test_dot_products_of_limbs_are_exact(k, n, m, bits, seed):
    r = np.random.default_rng(seed)
    a, b = (r.integers(-(1 << bits), (1 << bits) + 1, (x, k)) for x in (n, m))
    assert vector_codes.exact_dot(a, b).tolist() == [[sum(x * y for x, y in zip(p, q)) for q in b.tolist()] for p in a.tolist()]


def test_limbs_put_together_are_the_numbers():
    a = np.array([[0, -1, 1, (1 << 50) + 3, -(1 << 50) - 3, -(1 << 24), (1 << 24) - 1]])
    for width in (5, 11, 24):
        parts = vector_codes.limbs(a, width)
        assert sum(int(1 << width * i) * x.astype(object) for i, x in enumerate(parts)).tolist() == a.tolist()
        assert all(abs(x).max() <= 1 << width for x in parts)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "c", 1, 2) for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string, error long, vector int")


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error, digest) of rows of one size, with Python's integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1])
    cut = lambda v, p: v[d * p // parts : d * (p + 1) // parts]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((far(cut(v, p), e), k) for k, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), f in zip(kept, found) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    found, total = assign(), defaultdict(int)
    for (_, _, c), f in zip(kept, found):
        total[c] += sum(x for x, _ in f)
    sha = sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in f), sum(x for x, _ in f), total[c], sha) for (i, _, c), f in zip(kept, found))


def codes(df, **fitted):
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(df, **fitted).collect())


@pytest.mark.parametrize("kind, scale", [("float", 1.0), ("double", 3e4)])
def test_vector_codes(spark, kind, scale):
    r = np.random.default_rng(2)
    rows = [(int(i), (r.normal(size=8).astype(np.float32) * scale).tolist(), [None, 0, 1][i % 3]) for i in r.permutation(60)]
    nan, inf = float("nan"), float("inf")
    rows += [(100, None, 0), (101, [0.5, None] + [0.0] * 6, 0), (102, [nan] + [0.0] * 7, 1), (-5, [inf] + [0.0] * 7, 1), (None, [0.25] * 8, None), (3, rows[0][1], 1), (3, rows[0][1], 1), (200, [0.0] * 8, 1), (201, [0.0] * 8, 1), (202, [-0.0001] * 8, 1)]
    for entries in (5, 256):
        assert codes(vectors(spark, rows, kind).repartition(5), entries=entries) == brute_codes(rows, entries=entries)


def test_vectors_of_sizes_that_parts_do_not_divide(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=7).astype(np.float32).tolist(), i % 2) for i in range(20)]
    want = brute_codes(rows, entries=4)
    got = codes(vectors(spark, [*rows, (50, [1.0, 2.0], 1), (51, [], None)]), entries=4)
    assert {x for x in got if x[0] < 50} == set(want) and {x[:3] for x in got if x[0] >= 50} == {(50, None, None), (51, None, None)}
    short = [(i, [float(i)], 0) for i in range(3)]
    assert codes(vectors(spark, short)) == brute_codes(short)


def test_no_usable_vector(spark):
    assert codes(vectors(spark, [])) == Counter()
    assert codes(vectors(spark, [(1, None, 0), (2, [None], 1), (3, [float("nan")], None)])) == Counter()
    assert [x[:3] for x in codes(vectors(spark, [(1, [], 0)]))] == [(1, "00000000", 0)]


def test_vectors_out_of_range_are_an_error(spark):
    with pytest.raises(ValueError):
        vector_codes.compress(vectors(spark, [(1, [1e30], 0)]))


# sentence pieces


@pytest.fixture(scope="module")
def piece_model():
    return sentence_pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def codec(piece_model):
    return sentence_pieces.Codec(piece_model), sentencepiece.SentencePieceProcessor(model_proto=piece_model)


PARTS = st.sampled_from(["▁", " ", "  ", "\n", "\t", "\x00", "<s>", "</s>", "<0x41>", "<unk>", "漢字", "é", "é", "😀", "　", "１", "the", "The", "ing", ",", ".", "'s", "0", "\r\n", "ß", "http://"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(PARTS, st.text(max_size=6)), max_size=14).map("".join))
def test_texts_are_encoded_and_decoded_as_by_the_library(codec, text):
    own, library = codec
    ids = own.encode(text)
    assert ids == library.encode(text, add_eos=True) and own.decode(ids) == library.decode(ids)
    assert own.encode(text, end=False) == ids[:-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 258), st.integers(0, 31999), st.just(29871)), max_size=10))
def test_any_ids_are_decoded_as_by_the_library(codec, ids):
    assert codec[0].decode(ids) == codec[1].decode(ids)


def test_a_long_word_takes_no_quadratic_time(codec):
    own, library = codec
    r = random.Random(1)
    for text in ("x" * 300_000, "".join(r.choice("abcdefghij") for _ in range(300_000))):
        began = time.time()
        ids = own.encode(text)
        assert time.time() - began < 20 and ids == library.encode(text, add_eos=True)


def test_what_is_remembered_is_bounded_and_changes_nothing(piece_model, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 3)
    own, library = sentence_pieces.Codec(piece_model), sentencepiece.SentencePieceProcessor(model_proto=piece_model)
    for text in ("one two three", "four five six seven", "one two three"):
        assert own.encode(text) == library.encode(text, add_eos=True)


def test_a_difference_from_the_library_is_an_error(piece_model):
    own, library = sentence_pieces.Codec(piece_model), sentencepiece.SentencePieceProcessor(model_proto=piece_model)
    own.encode("this is right, even the long wo" + "r" * 100 + "d")
    assert len(own.fresh) > 5
    own.check(library)
    assert own.fresh == []
    own.rank.clear()
    own.encode("now")
    with pytest.raises(ValueError):
        own.check(library)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="thearing▁1,.", min_size=2, max_size=60))
def test_both_kinds_of_agenda_merge_alike(codec, text):
    assert codec[0].merged(text) == codec[0]._merged_by_heap(text)


def test_other_kinds_of_vocabularies_are_refused():
    with pytest.raises(ValueError):
        sentence_pieces.Codec(b"\x0a\x05\x0a\x03abc\x12\x02\x18\x01")


def test_encode_and_decode(spark, piece_model, codec):
    long = "\n".join("Eauouon lé the of  and, 12" * 20 for _ in range(300))
    rows = [(1, None), (2, ""), (3, " "), (4, long), (5, long), (6, "a"), (6, "a"), (None, "no id"), (7, "▁ x"), (8, "\n\n")]
    got = sentence_pieces.encode_and_decode(documents(spark, rows), piece_model).collect()
    library = codec[1]
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((i, tuple(ids), library.decode(ids)))
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == Counter(want)
    assert sentence_pieces.encode_and_decode(documents(spark, []), piece_model).count() == 0


# long texts in earlier operators


def test_personal_data_in_long_words_takes_linear_time(spark):
    from plumbline.llm import privacy

    r = random.Random(3)
    texts = ["x" * 1_000_000, "a@" + ".".join("b" for _ in range(100_000)), "".join(r.choice("abcdefgh0123456789+/") for _ in range(1_000_000)), "a." * 300_000 + "@", "mail ann.lee@example.com now"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = {row.doc_id: row for row in privacy.pseudonymised(df).collect()}
    assert time.time() - began < 60 and len(got) == 5
    assert privacy.pseudonymised(spark.createDataFrame([(0, texts[0])], "doc_id long, text string")).count() == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(1, 9)), max_size=40), st.integers(1, 5))
def test_segments_are_those_of_the_plain_search(steps, cost):
    from plumbline.llm import toxicity

    at, weights, p = [], [], -1
    for gap, w in steps:
        p += gap
        at.append(p)
        weights.append(float(w))
    stack, total, previous = [], 0.0, -1
    for p, w in zip(at, weights):
        total -= cost * (p - previous - 1)
        seg = [total, total + w, p, p]
        total, previous = total + w, p
        while True:
            j = max((k for k in range(len(stack)) if stack[k][0] < seg[0]), default=-1)
            if j < 0 or stack[j][1] >= seg[1]:
                break
            seg = [stack[j][0], seg[1], stack[j][2], seg[3]]
            del stack[j:]
        stack.append(seg)
    assert toxicity.segments(at, weights, -float(cost)) == [(s[2], s[3], s[1] - s[0]) for s in stack]


def test_segments_of_many_words_far_apart_take_linear_time():
    from plumbline.llm import toxicity

    n = 200_000
    began = time.time()
    assert len(toxicity.segments(list(range(0, 50 * n, 50)), [1.0] * n, -1.0)) == n
    assert len(toxicity.segments(list(range(n)), [1.0, 0.5] * (n // 2), -1.0)) == 1
    assert time.time() - began < 10
