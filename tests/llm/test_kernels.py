"""Kernels against plain Python."""

import gzip
import io
import itertools
import json
import random
import struct
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from ordinaut.llm import decontaminate as D
from ordinaut.llm import media as M
from ordinaut.llm import packing as K
from ordinaut.llm import quality as Q
from ordinaut.llm import tokens as W
from ordinaut.llm import toxicity as X
from ordinaut.llm import warc
from ordinaut.llm.bagminhash import band_keys, signatures


def words(text):
    """The definition of a word, character by character."""
    out, now = [], ""
    for c in text.lower():
        if c.isascii() and not c.isalnum():
            out, now = ([*out, now] if now else out), ""
        else:
            now += c
    return [*out, now] if now else out


def own(text):
    return W.tokens([text])[0]


TEXTS = ["", " ", "a", "A-b c", "don't Stop", "ÄÖ über 12x", "\n\n x\ty  ", "z" * 5000, "one two one two one two one two", "!!! ... ###"]


def test_tokens_follow_the_definition():
    hashes, at, sizes = W.tokens(TEXTS)
    seen = {}
    for i, text in enumerate(TEXTS):
        got = hashes[at[i] : at[i + 1]].tolist()
        assert len(got) == len(words(text))
        for w, h in zip(words(text), got, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert all((own(t) == hashes[at[i] : at[i + 1]]).all() for i, t in enumerate(TEXTS))
    assert len(W.tokens([])[0]) == 0


def jaccard(a, b, k=5):
    def bag(t):
        w = words(t)
        return Counter([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0


def test_multiset_jaccard():
    draw = random.Random(3)
    for _ in range(60):
        a = [draw.choice("abc") for _ in range(draw.randrange(0, 40))]
        b = a[:]
        for _ in range(draw.randrange(0, 4)):
            b.insert(draw.randrange(0, len(b) + 1), draw.choice("abcd"))
        a, b = " ".join(a), " ".join(b)
        assert W.multiset_jaccard(own(a), own(b)) == pytest.approx(jaccard(a, b))


def test_signatures_are_unbiased():
    draw = np.random.default_rng(5)
    for _ in range(4):
        keys = draw.integers(0, 2**63, 50).astype(np.uint64)
        a, b = draw.integers(1, 12, 50), draw.integers(0, 12, 50)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        got = signatures([keys, keys[b > 0]], [a, b[b > 0]], 8192)
        assert abs((got[0] == got[1]).mean() - want) < 0.03
    alone = signatures([keys[::-1].copy(), np.zeros(0, np.uint64)], [a[::-1].copy(), np.zeros(0, int)], 64)
    assert (alone[0] == signatures([keys], [a], 64)[0]).all() and (alone[1] == ~np.uint64(0)).all()
    assert band_keys(alone, 8, 8).shape == (2, 8)


def test_signatures_do_not_depend_on_the_batch():
    draw = np.random.default_rng(6)
    keys = [draw.integers(0, 2**63, n).astype(np.uint64) for n in (1, 3, 900, 40)]
    counts = [draw.integers(1, 30, len(k)) for k in keys]
    together = signatures(keys, counts, 128)
    assert all((together[i] == signatures([keys[i]], [counts[i]], 128)[0]).all() for i in range(4))


def slow_tiles(item, doc, least):
    """Greedy string tiling as defined: longest unmarked common run first, again and again."""
    mi, md, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in mi and j + n not in md:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return sum(n for n, _, _ in out)
        out.append(best)
        mi.update(range(best[1], best[1] + best[0]))
        md.update(range(best[2], best[2] + best[0]))


def test_tiles_equal_brute_force():
    draw = random.Random(9)
    for _ in range(80):
        item = [draw.choice("abcdefgh") for _ in range(draw.randrange(5, 30))]
        doc = [draw.choice("abcdefgh") for _ in range(draw.randrange(0, 25))] + item[draw.randrange(0, 5) :] + item[: draw.randrange(0, 9)]
        items = D.Items([1], [" ".join(item)], 3)
        got = items.search([" ".join(doc)])
        assert sum(n for _, _, n, _ in got) == slow_tiles(item, doc, 3)


def test_tiles_of_repeated_words_equal_brute_force():
    draw = random.Random(10)
    for k in range(80):
        letters = "ab" if k % 2 else "abcd"
        item = [draw.choice(letters) for _ in range(draw.randrange(3, 30))]
        doc = [draw.choice(letters) for _ in range(draw.randrange(0, 40))] + item[draw.randrange(0, 5) :]
        want = slow_tiles(item, doc, 3)
        assert sum(n for n, _, _ in D.tiles_by_length(own(" ".join(item)), own(" ".join(doc)), 3)) == want
        assert sum(n for _, _, n, _ in D.Items([1], [" ".join(item)], 3).search([" ".join(doc)])) == want
    tracemalloc.start()
    assert D.Items([1], ["x " * 3000]).search(["x " * 20_000, "y " * 9]) == [(0, 0, 3000, 1)]
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()
    items = D.Items([1, 2], ["a b c d e f g h i j", "a b c d e x y z"])
    assert items.search(["a b c d e", "f g h i j k"], 0.6) == [(0, 1, 5, 1)] and len(items.search(["a b c d e"])) == 2


def test_reordered_passages_are_covered():
    a, b = " ".join(f"w{i}" for i in range(12)), " ".join(f"v{i}" for i in range(9))
    items = D.Items([7, 8, 9], [f"{a} {b}", "too short", ""])
    assert items.search([f"x {b} y {a} z", "", "too short", f"{a} {a}"]) == [(0, 0, 21, 2), (3, 0, 12, 1)]


def test_media_round_trip():
    for n in (0, 1, 191, 192, 193, 192 * 12, 192 * 12 + 1, 192 * 100):
        text = "é" * n
        file = M.mux(M.payload_of(text))
        track = M.main_track(M.probe(file))
        assert M.samples_of(file, track) == text.encode().ljust(max(1, -(-2 * n // 192)) * 192)
        assert track.codec == "raw " and track.ticks == track.count == len(M.payload_of(text)) // 192 and (track.width, track.height) == M.FRAME
        assert [file[a : a + k] for a, k in track.key_ranges()] == [M.payload_of(text)[i : i + 192] for i in range(0, len(M.payload_of(text)), 192 * 12)]


def test_media_that_is_none():
    whole = M.mux(M.payload_of("x" * 5000))
    for bad in (b"", b"abc", b"\0" * 40, whole[8:30]):
        with pytest.raises(ValueError):
            M.probe(bad)
    for cut in range(0, len(whole), 37):  # any cut gives tracks or a reason, never another failure
        try:
            M.probe(whole[:cut])
        except ValueError:
            pass


def file_of(stbl, scale=100, more=b"", handler=b"vide", ticks=7):
    """A file of one track with the given tables."""
    mdia = M._box(b"mdia", M._full(b"mdhd", struct.pack(">IIIIHH", 0, 0, scale, ticks, 0, 0)), M._full(b"hdlr", bytes(4), handler, bytes(13)), M._box(b"minf", M._box(b"stbl", *stbl)))
    trak = M._box(b"trak", M._full(b"tkhd", struct.pack(">IIIII", 0, 0, 3, 0, 0)), mdia)
    return M._box(b"moov", trak, *([more] if more else []))


def table(kind, *rows, form=">I", version=0):
    return M._full(kind, struct.pack(">I", len(rows)), *(struct.pack(form, *(r if isinstance(r, tuple) else (r,))) for r in rows), version=version)


def test_sample_tables_are_decoded():
    sizes = [3, 5, 2, 7, 1, 4]
    stbl = [
        M._full(b"stsz", struct.pack(">II", 0, 6), struct.pack(">6I", *sizes)), table(b"stsc", (1, 2, 1), (3, 1, 1), form=">III"), table(b"stco", 1000, 2000, 3000, 4000),
        table(b"stss", 1, 4, 6), table(b"stts", (2, 10), (3, 20), (9, 5), form=">II"), table(b"ctts", (1, 4), (4, -2), (1, 6), form=">Ii", version=1),
    ]
    t = M.probe(file_of(stbl))[0]
    assert t.count == 6 and t.ticks == 2 * 10 + 3 * 20 + 5 and t.number == 3
    assert t.key_ranges() == [(1000, 3), (2002, 7), (4000, 4)]
    assert t.key_times().tolist() == [0.04, 0.38, 0.86]
    for bits, raw in ((4, bytes((0x35, 0x27, 0x14))), (8, bytes(sizes)), (16, struct.pack(">6H", *sizes))):
        own = M.probe(file_of([M._full(b"stz2", struct.pack(">II", bits, 6), raw), *stbl[1:]]))[0]
        assert own.key_ranges() == t.key_ranges() and own.ticks == t.ticks
    # no more samples than sizes, no more chunks than offsets
    assert M.probe(file_of([M._full(b"stsz", struct.pack(">II", 0, 3), struct.pack(">3I", *sizes[:3])), *stbl[1:]]))[0].count == 3
    assert M.probe(file_of([*stbl[:2], table(b"stco", 1000, 2000), *stbl[3:]]))[0].count == 4
    one_size = [M._full(b"stsz", struct.pack(">II", 10, 6)), *stbl[1:3]]
    assert M.probe(file_of(one_size) + bytes(5000))[0].key_ranges() == [(1000, 20), (2000, 20), (3000, 10), (4000, 10)]
    assert M.probe(file_of(one_size) + bytes(5000))[0].ticks == 7  # the header's, without a table


def test_movie_fragments_are_decoded():
    trex = M._box(b"mvex", M._full(b"trex", struct.pack(">5I", 3, 1, 40, 50, M.NOT_SYNC)))
    head = M._FTYP + file_of([table(b"stsc", form=">III"), table(b"stco")], more=trex)

    def fragment(*boxes):
        return M._box(b"moof", M._full(b"mfhd", bytes(4)), M._box(b"traf", *boxes))

    tfhd = M._full(b"tfhd", struct.pack(">I", 3), flags=0x20000)
    one = fragment(tfhd, M._full(b"trun", struct.pack(">IiI", 2, 500, 0), struct.pack(">II", 9, 8), flags=0x205))
    two = fragment(M._full(b"tfhd", struct.pack(">IQI", 3, 900, 7), flags=9), M._full(b"trun", struct.pack(">I", 3), struct.pack(">9I", 1, 0, 5, 2, M.NOT_SYNC, 0, 3, 0, 0), flags=0xE00))
    rest = fragment(tfhd, M._full(b"trun", struct.pack(">IiI", 1 << 31, 0, 0), flags=5))
    other = fragment(M._full(b"tfhd", struct.pack(">I", 99)), M._full(b"trun", struct.pack(">I", 5)))
    file = head + one + two + other + rest + bytes(2000)
    t = M.probe(file)[0]
    start = len(head) + len(one + two + other)
    many = (len(file) - start) // 50  # of a claim of 2^31 samples of 50 bytes
    assert t.count == 5 + many and t.ticks == 2 * 40 + 3 * 7 + 40 * many
    assert t.key_ranges()[:4] == [(len(head) + 500, 9), (900, 1), (903, 3), (start, 50)]
    assert np.allclose(t.key_times()[:4], [0, (80 + 5) / 100, (80 + 14) / 100, 101 / 100])
    assert len(M.samples_of(file, t)) == 9 + 8 + 1 + 2 + 3 + 50 * many


def test_claimed_numbers_cost_no_memory():
    file = M.mux(M.payload_of("x" * 2000))
    for word in range(0, file.index(b"mdat"), 4):  # each 32-bit word in turn claims a great number
        for claim in (0xFFFFFFFF, 50_000_000):
            bad = file[:word] + claim.to_bytes(4, "big") + file[word + 4 :]
            tracemalloc.start()
            try:
                t = M.main_track(M.probe(bad))
                assert len(M.samples_of(bad, t)) <= len(bad) and len(t.key_ranges()) <= len(bad)
                M.feature_of(t)
            except ValueError:
                pass
            assert tracemalloc.get_traced_memory()[1] < 4 << 20
            tracemalloc.stop()


def test_wide_boxes_and_variable_samples():
    big = M._box(b"free", b"12345")
    wide = b"\0\0\0\1free" + (16 + 5).to_bytes(8, "big") + b"12345"
    assert [(k, bytes(memoryview(x)[a:b])) for x in (big, wide) for k, a, b in M.boxes(memoryview(x))] == [(b"free", b"12345")] * 2
    assert [k for k, _, _ in M.boxes(memoryview(b"\0\0\0\0mdatrest"))] == [b"mdat"]


def test_warc_normaliser():
    pages = [(1, b"hello", None), (2, b"", None), (3, b"hello", 1), (4, b"\r\n\r\nWARC/1.1\r\n" * 50_000, None)]
    raw = b"".join(warc.record(*p) for p in pages)
    for source in (gzip.compress(raw), b"".join(gzip.compress(warc.record(*p)) for p in pages)):
        sink = io.BytesIO()
        index = list(warc.normalise(io.BytesIO(source), sink))
        out = sink.getvalue()
        assert gzip.decompress(out) == raw and json.loads(json.dumps(index)) == index
        got = [warc.read_member(out[e["offset"] : e["offset"] + e["length"]]) for e in index]
        assert got == [(i, len(p if r is None else b"hello"), warc.digest_of(p), "response" if r is None else "revisit", r) for i, p, r in pages]
    with pytest.raises(ValueError):
        list(warc.normalise(io.BytesIO(gzip.compress(raw[:-30])), io.BytesIO()))
    assert b"WARC-Target-URI: http://x/a%20b%0D%0Ac\r\n" in warc.record(1, b"", None, "http://x/a b\r\nc") and b"URI" not in warc.record(1, b"")


def test_archives_that_are_cut_or_damaged(monkeypatch):
    raw = [warc.record(i, bytes([97 + i]) * 40 * i, 1 if i == 2 else None) for i in range(4)]
    whole, members = gzip.compress(b"".join(raw)), b"".join(map(gzip.compress, raw))
    for piece in (1 << 20, 7):
        monkeypatch.setattr(warc, "PIECE", piece)
        for source in (whole, members):
            n = lambda data: len(list(warc.normalise(io.BytesIO(data), io.BytesIO())))
            ends = {0} if source is whole else {0, *itertools.accumulate(len(gzip.compress(r)) for r in raw)}
            for cut in range(len(source)):
                if cut in ends:  # a whole number of members
                    assert n(source[:cut]) == sum(e <= cut for e in ends) - 1
                else:
                    with pytest.raises(ValueError):
                        n(source[:cut])
            assert n(source) == n(source + b"\0" * 700) == 4 and n(b"") == n(b"\0" * 9) == 0
            for bad in (source + b"junk", source[:-5] + bytes([source[-5] ^ 1]) + source[-4:], b"x" + source):
                with pytest.raises(ValueError):
                    n(bad)
    assert list(warc.normalise(io.BytesIO(gzip.compress(b"")), io.BytesIO())) == []


@pytest.fixture(scope="module")
def encoder():
    return K.Encoder(public_tokenizers.path(K.TOKENIZER))


def test_encoder_equals_the_tokenizer(encoder):
    texts = ["", " ", "  a", "a  b", "a \n b", "it 's it's", "\n", "x <|endoftext|> y", "a b ", "\t a", "naïve café 東京 🙂 x", "a b c", "1 22 333", "!!! ... a", "　 x", "A" * 3000]
    draw = random.Random(4)
    texts += ["".join(draw.choice(" \n\tab1é!'s. ") for _ in range(40)) for _ in range(400)]
    for text, ids in zip(texts, encoder(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_plan_packs_every_piece():
    draw = random.Random(8)
    for limit, n in ((10, 50), (64, 500), (2048, 3000)):
        sizes = Counter(min(limit, 1 + int(draw.expovariate(3 / limit))) for _ in range(n))
        bins = K.plan(sizes.items(), limit)
        assert Counter({k: v for k, v in sum((Counter({x: m * c for x, c in Counter(took).items()}) for m, took in bins), Counter()).items()}) == sizes
        assert all(sum(took) <= limit for _, took in bins)
        least = -(-sum(k * v for k, v in sizes.items()) // limit)
        assert sum(m for m, _ in bins) <= 1.05 * least + 2
        spots = Counter()
        for length, begin, end, uses, sequence, at in K.places(bins):
            for rank in range(begin, end):
                for t in range(length):
                    spots[(sequence + (rank - begin) // uses, at + (rank - begin) % uses * length + t)] += 1
        assert set(spots.values()) == {1} and len(spots) == sum(k * v for k, v in sizes.items())
        assert all(p == 0 or (s, p - 1) in spots for s, p in spots)
    assert K.plan([], 10) == []


def plain_best_two_fit(sizes, limit):
    """One bin after another from a list of pieces."""
    left, out = sorted(sizes, reverse=True), []
    while left:
        took = [left.pop(0)]
        while fit := next((x for x in left if x <= limit - sum(took)), None):
            left.remove(fit)
            took.append(fit)
        if sum(took) < limit and len(took) > 1:
            small = min(took)
            room = limit - sum(took) + small
            best = (small, 0, 0)
            for one in sorted(set(left)):
                rest = left[:]
                rest.remove(one)
                two = next((x for x in rest if x <= room - one), 0)
                if two and one + two > best[0]:
                    best = (one + two, one, two)
            if best[1]:
                took.remove(small)
                for x in best[1:]:
                    left.remove(x)
                    took.append(x)
                left = sorted([*left, small], reverse=True)
        out.append(sorted(took, reverse=True))
    return out


def test_plan_is_the_plain_method():
    draw = random.Random(12)
    for _ in range(150):
        limit = draw.choice((10, 24, 50))
        kinds = [draw.randint(1, limit) for _ in range(draw.randint(1, 12))]
        sizes = [draw.choice(kinds) for _ in range(draw.randint(0, 60))]
        got = [took for times, took in K.plan(Counter(sizes).items(), limit) for _ in range(times)]
        assert got == plain_best_two_fit(sizes, limit), (limit, sizes)


def test_two_for_the_smallest():
    assert K.plan([(6, 1), (3, 1), (2, 2)], 10) == [(1, [6, 2, 2]), (1, [3])]


def slow_grams(text):
    """The n-grams themselves."""
    raw = f" {text.lower()} ".encode()
    return {raw[i : i + order] for order in X.ORDERS for i in range(len(raw) - order + 1)}


def slow_hash(gram):
    h = 0
    for b in gram:
        h = (h * 0x01000193 + b) & 0xFFFFFFFF
    h = (h + len(gram)) * 0x9E3779B1 & 0xFFFFFFFF
    return h ^ h >> 15


def test_grams_are_those_of_the_text():
    for text in ("", "a", "Some words, some WORDS", "é" * 50):
        assert X.grams(text).tolist() == sorted({slow_hash(g) for g in slow_grams(text)})
    long = "abc xyz " * 300_000  # more than a block
    assert X.grams(long).tolist() == X.grams("abc xyz " * 4).tolist()
    useful = np.zeros(1 << 22, bool)
    some = X.grams("Some words")
    useful[some[::3] >> np.uint32(10)] = True
    assert X.grams("Some words", useful).tolist() == [g for g in some.tolist() if useful[g >> 10]]


def plain_descent(gradient, n, steps=4000, rate=0.5):
    w = np.zeros(n)
    for _ in range(steps):
        w = w - rate * gradient(w)
    return w


def test_toxicity_fit_minimises_the_loss():
    draw = np.random.default_rng(3)
    ratio = draw.uniform(1.5, 3, 12)
    docs = [np.flatnonzero(draw.random(12) < 0.3).astype(np.uint32) for _ in range(80)]
    toxic = np.array([len(d) + 2 * draw.random() > 4 for d in docs])
    x = np.array([[ratio[k] * (k in d) for k in range(12)] + [1] for d in docs])
    share = [0.5 / toxic.sum() if t else 0.5 / (~toxic).sum() for t in toxic]

    def loss(w):
        z = [sum(a * b for a, b in zip(r, w, strict=True)) for r in x]
        return sum(s * np.log1p(np.exp(-v if t else v)) for s, v, t in zip(share, z, toxic, strict=True)) + 0.005 * sum(w[:-1] ** 2)

    gradient = lambda w: x.T @ (share * (1 / (1 + np.exp(-(x @ w))) - toxic)) + 0.01 * np.append(w[:-1], 0)
    best = plain_descent(gradient, 13)
    got = X.fit_scorer(docs, toxic, np.arange(12, dtype=np.uint32), ratio, steps=2000, ridge=0.01)
    assert loss(np.append(got.weights / ratio, got.bias)) < loss(best) * 1.001
    assert np.allclose(got.weights / ratio, best[:-1], atol=0.02) and abs(got.bias - best[-1]) < 0.05


def test_ranker_maximises_the_likelihood_of_pairs():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(60, Q.N_FEATURES)) * draw.uniform(0.1, 9, Q.N_FEATURES)
    good = x[:, 0] / x[:, 0].std() + x[:, 5] / x[:, 5].std() + draw.normal(size=60) > 0.3
    first, other = Q.drawn_pairs(good)
    assert good[first].all() and not good[other].any() and len(first) == 20 * 60
    assert np.ptp(np.bincount(first, minlength=60)[good]) <= 1 and np.ptp(np.bincount(other, minlength=60)[~good]) <= 1
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)

    def loss(w):
        return sum(np.log1p(np.exp(-(z[a] @ w - z[b] @ w))) for a, b in zip(first, other, strict=True)) / len(first) + 0.005 * w @ w

    d = z[first] - z[other]
    best = plain_descent(lambda w: -(d.T @ (1 / (1 + np.exp(d @ w)))) / len(d) + 0.01 * w, Q.N_FEATURES, 3000, 0.2)
    ranker = Q.fit_ranker(x, good, steps=3000, ridge=0.01)
    assert loss(ranker.weights) < loss(best) * 1.002
    strength = sorted(ranker.strength(x))
    k = int((~good).sum())
    assert ranker.cut == pytest.approx((strength[k - 1] + strength[k]) / 2)
    assert Q.fit_ranker(x, good).weights @ best / np.linalg.norm(best) ** 2 > 0.5  # the same direction after the usual steps


def test_quality_features_and_ranker():
    texts = ["", "plain words here", "BAD!!! BAD!!! BAD!!!", "x" * 100_000, "a\nb\na"]
    x = Q.features(texts)
    assert np.isfinite(x).all() and (x[0] == 0).all()
    draw = np.random.default_rng(1)
    z = draw.normal(size=(400, Q.N_FEATURES))
    good = z[:, 3] + 0.1 * draw.normal(size=400) > -1
    ranker = Q.fit_ranker(z, good)
    assert ((ranker.score(z) >= 0.5) == good).mean() > 0.95
    assert (Q.fit_ranker(z, np.ones(400, bool)).score(z) == 0.5).all() and (Q.fit_ranker(z[:0], good[:0]).score(z) == 0.5).all()


def test_toxicity_fit_on_one_kind():
    ids = np.zeros(0, np.uint32)
    assert X.fit_scorer([], np.zeros(0, bool), ids, np.zeros(0)).score(["", "x"]).tolist() == [0.5, 0.5]
    assert X.fit_scorer([ids], np.ones(1, bool), ids, np.zeros(0)).score([""])[0] > 0.9


def test_crc_is_unsigned():
    assert zlib.crc32(b"\xff" * 16) >= 0
    assert list(itertools.islice(W.windows(np.arange(3, dtype=np.uint64), 5), 1)) == []
