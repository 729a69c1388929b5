"""Operators over frames, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import base64
import glob
import hashlib
import itertools
import math
import os
import random
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ordinaut.llm import common, components, decontaminate, licenses, media, neardup, packing, quality, sharding, toxicity, urls, warc
from ordinaut.llm.common import id_text, read_table
from ordinaut.llm.queries import ORACLE_SQL, QUERIES
from ordinaut.llm.tokens import multiset_jaccard, tokens, windows

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, score double, rep long, key string"


def docs(spark, *rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "w", 0.5, 1, "k") for i, t in rows], SCHEMA)


def collected(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


ODD = [(1, None), (2, ""), (3, "short"), (3, "short"), (None, "no id here at all but words"), (5, "x " * 30_000), (6, "!!! ***"), (7, "short")]


@pytest.fixture(scope="module")
def labels(spark):
    return read_table(spark, SF, "labels")


@pytest.fixture(scope="module")
def real(spark):
    return read_table(spark, SF, "documents")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    want = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert sorted(collected(df, *columns), key=repr) == sorted(want, key=repr)


def test_license_scan(spark):
    mit = next(t for i, t in licenses.KNOWN if i == "MIT")
    other = "Copyright (c) 2020 A. Body\n" + mit.upper().replace(",", " ;").replace("NONINFRINGEMENT", "noninfringement")
    isc = next(t for i, t in licenses.KNOWN if i == "ISC").replace(" and ", "   and\n")
    rows = docs(spark, (1, mit), (2, other), (3, isc), (4, "text\nReleased under the MIT licence\nmore\n(c) me"), (5, mit + " but"), *((i and i + 10, t) for i, t in ODD))
    got = {r[0]: r[1:] for r in collected(licenses.scan(rows, licenses.known_digests(spark)), "doc_id", "license_id", "notices")}
    assert [got[i][0] for i in (1, 2, 3, 4, 5)] == ["MIT", "MIT", "ISC", None, None] and got[4][1] == "MIT"
    assert licenses.scan(rows, licenses.known_digests(spark)).count() == 13
    assert licenses.scan(rows.limit(0), licenses.known_digests(spark)).count() == 0


def test_spelling_pairs(spark):
    a = "The licence, sub-licence; and SUB LICENSE of the organisation's programme at https://x. Licence licence"
    b = "the license sublicense and sublicense of the organization s program at http x license license"
    got = licenses.with_canonical(spark.createDataFrame([(a,), (b,)], "t string"), "t").collect()
    assert got[0][0] == got[1][0] == b


def test_license_case_is_folded_in_every_alphabet(spark):
    known = licenses.known_digests(spark, [("ES", "Licencia Española, versión única"), ("RU", "Лицензия с Открытым кодом")])
    rows = docs(spark, (1, "LICENCIA ESPAÑOLA, VERSIÓN ÚNICA"), (2, "лицензия С ОТКРЫТЫМ КОДОМ"), (3, "x\nlicencia espaÑola versiÓn Única\ny"), (4, "ÜBER Στο"), (5, "über ΣΤΟ"))
    got = {r[0]: r[1:] for r in collected(licenses.scan(rows, known), "doc_id", "license_id", "notices", "digest")}
    assert [got[i][:2] for i in (1, 2, 3)] == [("ES", "ES"), ("RU", "RU"), (None, "ES")] and got[4][2] == got[5][2]


def test_license_texts_wrap_anywhere(spark):
    statements = ("Copyright (c) 2020 A. Body", "copyright © A. Body", "Copyright 2019-2021 the authors", "COPYRIGHT JANE DOE", "Copyright by The Regents", "Copyright <year> <owner>", "(c) 2020 me", "(C) Jane Doe")
    texts = [(i, s + "\n\n" + "\n\n".join(textwrap.fill(p, width) for p in t.split("\n\n"))) for (i, t), s in zip(licenses.KNOWN[:8], itertools.cycle(statements)) for width in (*range(50, 91), 20)]
    texts += [("MIT", s + "\n" + licenses.KNOWN[1][1]) for s in statements]
    got = dict(collected(licenses.scan(docs(spark, *((k, t) for k, (_, t) in enumerate(texts))), licenses.known_digests(spark)), "doc_id", "license_id"))
    assert [got[k] for k in range(len(texts))] == [i for i, _ in texts]


def test_license_in_a_comment(spark):
    texts = []
    for name, text in licenses.KNOWN[:8]:
        for sign in ("# ", "// ", " * ", ";; ", "-- ", "#", "% "):
            for head in ("Copyright (c) 2020 A. Body", "Copyright 2019-2021 The Authors\nAll rights reserved.", "(C) Jane Doe\nCopyright 2001 J. Doe. All Rights Reserved"):
                lines = f"{head}\n\n{text}".split("\n")
                texts.append((name, "\n".join(sign + x for line in lines for x in (textwrap.wrap(line, 70) or [""]))))
    title, _, body = licenses.KNOWN[0][1].partition("\n\n")
    texts.append(("MIT", f"{title}\n\nCopyright (c) 2011 Somebody\nAll rights reserved.\n\n{body}"))
    got = dict(collected(licenses.scan(docs(spark, *((k, t) for k, (_, t) in enumerate(texts))), licenses.known_digests(spark)), "doc_id", "license_id"))
    assert [got[k] for k in range(len(texts))] == [i for i, _ in texts]


def test_license_notices_are_those_of_the_row(spark):
    notice = "text\nReleased under the MIT License.\nmore"
    rows = docs(spark, (1, notice), (1, "plain words"), (None, notice), (None, "other words"), (None, None), (2, notice), (2, notice))
    got = collected(licenses.scan(rows, licenses.known_digests(spark)), "doc_id", "notices")
    assert sorted(got, key=repr) == sorted([(1, "MIT"), (1, ""), (None, "MIT"), (None, ""), (None, ""), (2, "MIT"), (2, "MIT")], key=repr)


def test_long_license_texts_are_known(spark):
    names = {"Apache-2.0", "Artistic-1.0-Perl", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0"}
    whole = {i: t for i, t in reversed(licenses.known_texts()) if i in names and len(t) > 5000}
    assert set(whole) == names
    texts = list(whole.items())
    # texts with forms for statements in an appendix have those where they stand
    texts += [(i, "\n\n".join(textwrap.fill(p, width) for p in whole[i].split("APPENDIX")[0].split("\n\n"))) for i in ("Apache-2.0", "MPL-2.0", "CC0-1.0") for width in (65, 72, 79)]
    texts.append(("Apache-2.0", whole["Apache-2.0"].split("END OF TERMS")[0] + "END OF TERMS AND CONDITIONS\n"))
    got = dict(collected(licenses.scan(docs(spark, *((k, t) for k, (_, t) in enumerate(texts))), licenses.known_digests(spark)), "doc_id", "license_id"))
    assert [got[k] for k in range(len(texts))] == [i for i, _ in texts]


def test_media_columns(spark):
    files = media.mux_texts(id_text(docs(spark, *ODD)))
    got = media.digest_media(files).collect()
    assert len(got) == len(ODD)
    for r in got:
        text = next((t for i, t in ODD if i == r.doc_id), None) or ""
        pad = text.encode().ljust(max(1, -(-len(text.encode()) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
    table = spark.createDataFrame([(1, bytearray(media.mux(b"a" * 1920))), (2, None), (3, bytearray(b"junk"))], "id int, media binary")
    probed = {r.id: r for r in media.probe_media(table, "id", "media").collect()}
    assert probed[1].codec == "raw " and probed[1].duration_s == 10 / 25 and len(probed[1].keyframes) == 1 and probed[1].error is None
    assert probed[2].error == "no media" and probed[3].codec is None and probed[3].error
    assert media.digest_media(files.limit(0)).count() == 0


def brute_classes(rows):
    """Connected components over all pairs of words' multisets."""
    texts = [t or "" for _, t in rows]
    h, at, _ = tokens(texts)
    own = [h[at[i] : at[i + 1]] for i in range(len(texts))]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if multiset_jaccard(own[a], own[b]) >= 0.8:
            parent[find(a)] = find(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: low[find(i)] for i, (d, _) in enumerate(rows)}


def test_near_duplicates_equal_brute_force(spark):
    draw = random.Random(2)
    vocab = [f"w{k}" for k in range(300)]
    rows = []
    for base in range(12):
        words = [draw.choice(vocab) for _ in range(draw.choice((3, 8, 60, 150)))]
        for _ in range(draw.choice((1, 2, 5, 60 if base == 3 else 4))):  # one group of more than a small bucket
            w = words[:]
            for _ in range(draw.choice((0, 0, 1, 2, 4))):
                w[draw.randrange(len(w))] = draw.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "?! ."), (1003, rows[0][1]), (1003, rows[0][1]), (1004, "y " * 20_000)]
    odd = [(None, "a b c"), (None, "A b, c!"), (None, rows[0][1])]
    got = collected(neardup.near_duplicates(docs(spark, *rows, *odd)), "doc_id", "class_id")
    assert Counter(c for d, c in got if d is None) == Counter([None, None, 0]) and len(got) == len(rows) + 3
    want = brute_classes(sorted(set(rows), key=lambda r: r[0]))
    assert {d: c for d, c in got if d is not None} == want


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 3)
    draw = random.Random(5)
    words = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(90):  # a chain of edits: far members are linked through near ones only
        words[draw.randrange(120)] = f"e{i}"
        rows.append((i, " ".join(words)))
    got = dict(collected(neardup.near_duplicates(docs(spark, *rows)), "doc_id", "class_id"))
    assert got == brute_classes(rows)
    empty = neardup.near_duplicates(docs(spark, *rows).limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "class_id"]


def test_hot_keys_are_spread_and_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 3)
    monkeypatch.setattr(neardup, "SIDE", 5)
    monkeypatch.setattr(neardup, "GROUP", 4)
    monkeypatch.setattr(common, "HOT_ROWS", 6)
    draw = random.Random(11)
    base, rows = [f"b{k}" for k in range(100)], []
    for i in range(120):  # many pairs about the bound, in few large buckets, and copies of some
        words = base[:]
        for _ in range(draw.choice((1, 2, 3, 3, 4))):
            words[draw.randrange(100)] = f"e{draw.randrange(6)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, rows[i % 3][1].upper()) for i in range(40)]
    assert dict(collected(neardup.near_duplicates(docs(spark, *rows)), "doc_id", "class_id")) == brute_classes(rows)


def test_repeated_ids_are_told_apart(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = docs(spark, (1, a), (5, a), (5, b), (7, a), (7, b), (8, c), (8, c), (9, c + " more"), (None, b), (None, "alone here"), (None, "alone here"), (2, ""), (2, None))
    got = sorted(collected(neardup.near_duplicates(rows), "doc_id", "class_id"), key=repr)
    want = [(1, 1), (5, 1), (5, 5), (7, 1), (7, 5), (8, 8), (8, 8), (9, 8), (None, 5), (None, None), (None, None), (2, 2), (2, 2)]
    assert got == sorted(want, key=repr)
    kept = collected(neardup.one_of_each(rows), "doc_id", "text")
    assert len(kept) == 5 and {d: t or "" for d, t in kept} == {1: a, 5: b, 8: c, None: "alone here", 2: ""}
    assert neardup.one_of_each(rows).columns == rows.columns and neardup.one_of_each(rows.limit(0)).count() == 0


def test_links_are_counted_in_buckets_of_any_size(spark, monkeypatch):
    draw = random.Random(9)
    words = [f"b{k}" for k in range(150)] * 2
    rows = []
    for i in range(60):  # some pairs are similar enough, others are linked through third texts only
        w = words[:]
        for _ in range(i % 5):
            w[draw.randrange(300)] = f"e{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rows[i][1]) for i in (1, 1, 2, 30)] + [(200, "alone in the world of words"), (201, None)]
    rows = list(dict.fromkeys(rows)) + [(300, rows[5][1]), (300, rows[5][1])]
    own = {d: list(tokens([t or ""])[0]) for d, t in rows}
    every = [own[d] for d, _ in rows]  # a row that stands twice counts twice
    want = {a: sum(x != y and multiset_jaccard(np.array(x, np.uint64), np.array(y, np.uint64)) >= 0.8 for y in every) for a, x in own.items()}
    assert 0 < min(want[a] for a in range(60)) < max(want.values()) and want[5] > 24
    for block in (neardup.BLOCK, 7):
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = collected(neardup.link_counts(docs(spark, *rows)), "doc_id", "class_id", "n_links")
        assert len(got) == len(rows) and {d: n for d, _, n in got} == want
    assert sorted(collected(neardup.near_duplicates(docs(spark, *rows)), "doc_id", "class_id")) == sorted((d, c) for d, c, _ in got)


def test_near_duplicates_of_the_table(spark, real):
    rows = [tuple(r) for r in real.select("doc_id", "text").collect()]
    assert dict(collected(neardup.near_duplicates(id_text(real)), "doc_id", "class_id")) == brute_classes(rows)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (3, 3), (50, 49), (49, 48), (48, 47), (47, 46), (46, 1)]
    got = dict(collected(components.components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    assert got == {2: 1, 3: 1, 9: 8, 50: 1, 49: 1, 48: 1, 47: 1, 46: 1}


def test_decontamination(spark):
    passage = " ".join(f"q{i}" for i in range(20))
    half = " ".join(f"q{i}" for i in range(10, 20)) + " gap " + " ".join(f"q{i}" for i in range(10))
    bench = spark.createDataFrame([(1, passage), (2, "a b"), (3, None), (4, ""), (5, passage + " " + " ".join(f"r{i}" for i in range(40)))], "item_id long, text string")
    rows = docs(spark, (1, f"x {passage.upper()}! y"), (2, half), (3, "q0 q1 q2 q3 q4 q5"), (4, "a b"), (None, passage), *((i and i + 10, t) for i, t in ODD))
    want = [(1, 1, 20, 1), (2, 1, 20, 2), (None, 1, 20, 1)]
    got = collected(decontaminate.contaminated(rows, bench), "doc_id", "item_id", "matched_words", "tiles")
    assert sorted(got, key=repr) == sorted(want, key=repr)
    blocks = collected(decontaminate.contaminated(rows, bench, block_chars=100), "doc_id", "item_id", "matched_words", "tiles")
    assert sorted(blocks, key=repr) == sorted(want, key=repr)
    for size in (decontaminate.BLOCK_CHARS, 100):
        kept = decontaminate.clean(rows, bench, block_chars=size)
        assert kept.columns == rows.columns and sorted(r[0] for r in collected(kept, "doc_id") if r[0]) == [3, 4, 11, 12, 13, 13, 15, 16, 17]
    assert decontaminate.contaminated(rows, bench.limit(0)).count() == 0 and decontaminate.contaminated(rows.limit(0), bench).count() == 0


def test_tiling_of_the_table_equals_all_pairs(spark, real):
    """The query against every pair of a document and an item, tiled by the plain way of falling lengths."""
    bench = read_table(spark, SF, "benchmark")
    items = [(r.item_id, tokens([r.text or ""])[0]) for r in bench.collect()]
    want = []
    for r in real.collect():
        words = tokens([r.text or ""])[0]
        seen = set(windows(words, 5).tolist())
        for item, own in items:
            if seen.isdisjoint(windows(own, 5).tolist()):
                continue
            marked = sum(n for n, _, _ in decontaminate.tiles_by_length(own, words))
            if marked >= decontaminate.COVERAGE * len(own):
                want.append((r.doc_id, item, marked))
    got = collected(QUERIES["op4_string_tiling"](spark, SF), "doc_id", "item_id", "matched_words")
    assert sorted(got) == sorted(want) and want


def test_url_filter(spark):
    entries = spark.sql("""select * from values ('host', 'a.x.org', date'2024-01-10', 'add'), ('host', 'a.x.org', date'2024-01-20', 'remove'),
      ('domain', 'y.org', date'2024-01-05', 'add'), ('prefix', 'b.x.org/p', date'2024-01-01', 'add'), ('host', 'z.org', date'2024-01-01', 'add'), ('host', 'z.org', date'2024-01-01', 'remove'),
      ('host', 'a.x.org', date'2024-01-10', 'add'), (null, 'q', date'2024-01-01', 'add'), ('domain', 'b.x.org', date'2024-01-01', 'add') as t(kind, key, day, action)""")
    captures = spark.sql("""select * from values (1, 'http://a.x.org/', date'2024-01-09'), (2, 'HTTP://u:p@A.X.org.:80/q', date'2024-01-10'), (3, 'https://a.x.org', date'2024-01-20'),
      (4, 'http://m.n.y.org/a', date'2024-02-01'), (5, 'http://notY.org', date'2024-02-01'), (6, 'http://b.x.org/p/1', date'2024-01-01'), (7, 'http://b.x.org/r', date'2024-01-01'), (8, null, date'2024-01-15'),
      (9, 'junk', date'2024-01-15'), (10, 'http://z.org', date'2024-01-15'), (11, 'http://a.x.org/', null), (2, 'HTTP://u:p@A.X.org.:80/q', date'2024-01-10') as t(page_id, url, day)""").withColumn("kind", F.lit("clash"))
    got = collected(urls.filter_urls(captures, entries), "page_id", "blocked", "kind", "key")
    assert sorted(got) == sorted([
        (1, False, None, None), (2, True, "host", "a.x.org"), (2, True, "host", "a.x.org"), (3, False, None, None), (4, True, "domain", "y.org"), (5, False, None, None), (6, True, "prefix", "b.x.org/p"),
        (7, True, "domain", "b.x.org"), (8, False, None, None), (9, False, None, None), (10, False, None, None), (11, False, None, None),
    ])
    deep = spark.sql("""select * from values ('prefix', 'h.org/a/b', date'2024-01-01', 'add'), ('prefix', 'h.org/a', date'2024-02-01', 'add'), ('prefix', 'e.org/', date'2024-01-01', 'add') as t(kind, key, day, action)""")
    seen = spark.sql("""select * from values (1, 'http://h.org/a/b', date'2024-01-05'), (2, 'http://h.org/a/b/c?x=/y', date'2024-03-05'), (3, 'http://h.org/a/bc', date'2024-01-05'), (4, 'http://h.org/a/bc', date'2024-03-05'),
      (5, 'http://h.org/a', date'2024-01-05'), (6, 'http://e.org', date'2024-01-05'), (7, 'http://e.org/?q', date'2024-01-05'), (8, 'http://e.org/x', date'2024-01-05') as t(page_id, url, day)""")
    assert sorted(collected(urls.filter_urls(seen, deep), "page_id", "key")) == [(1, "h.org/a/b"), (2, "h.org/a/b"), (3, None), (4, "h.org/a"), (5, None), (6, "e.org/"), (7, "e.org/"), (8, None)]
    plan = urls.filter_urls(captures, entries)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert urls.filter_urls(captures, entries.limit(0)).where("blocked").count() == 0 and urls.filter_urls(captures.limit(0), entries).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "same"), (2, "same"), (3, None), (4, ""), (5, "é" * 9000), (6, "same"), (6, "same"), (None, "same"), (8, "alone")]
    pages = spark.createDataFrame([(i, "u", h, "x") for i, h in rows], "page_id long, url string, html string, sha string")
    want = []
    for i, h in rows:
        raw = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        top = max(j for j, g in rows if (g or "") == (h or "") and j is not None)
        want.append((i, len(raw), digest, "response" if i == top else "revisit", None if i == top else top))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(collected(warc.round_trip(pages), *names), key=repr) == sorted(want, key=repr)
    assert {r.record_type for r in warc.round_trip(pages, min_bytes=5).collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_are_cut_by_size(spark, tmp_path):
    pages = warc.with_roles(spark.range(50).select(F.col("id").alias("page_id"), F.repeat(F.lit("x"), 1000).alias("html")).withColumn("html", F.concat("html", "page_id")).coalesce(1))
    raw = warc.write_archives(pages, f"file://{tmp_path}/raw", archive_bytes=20_000)
    assert raw.count() > 1 and raw.agg(F.sum("records")).first()[0] == 50
    neat = warc.normalise_archives(raw, f"file://{tmp_path}/neat")
    assert warc.read_archives(neat).count() == 50 and len(glob.glob(f"{tmp_path}/neat/*.idx")) == raw.count()


def test_quality_scores(spark, real, labels):
    got = quality.quality_scores(real.unionAll(real.limit(1)), labels).toPandas()
    assert len(got) == real.count() + 1 and got.score.between(0, 1).all()
    marks = labels.toPandas().set_index("doc_id").quality
    own = got.drop_duplicates("doc_id").set_index("doc_id").score
    assert ((own.loc[marks.index] >= 0.5) == (marks == 1)).mean() > 0.95
    odd = collected(quality.quality_scores(docs(spark, *ODD), labels.where("doc_id < 0")), "doc_id", "score")
    assert len(odd) == len(ODD) and {s for _, s in odd} == {0.5}
    assert quality.quality_scores(docs(spark, *ODD).limit(0), labels).count() == 0


def test_quality_of_rare_marks(spark):
    draw = random.Random(4)
    clean = lambda: " ".join("a" * draw.randint(2, 9) + draw.choice("bcdefg") for _ in range(draw.randint(30, 90))) + "."
    rows = [(i, "$$$ 999 ### BUY !!! " * 9 + str(i) if i % 300 == 7 else clean()) for i in range(3000)]
    marks = spark.createDataFrame([(i, int(i % 300 != 7)) for i in range(3000)], "doc_id long, quality int")
    ranker = quality.learn(id_text(docs(spark, *rows)), marks, rows=40)  # such a sample of all labels holds none that is bad
    x = quality.features([t for _, t in rows])
    assert np.flatnonzero(ranker.score(x) < 0.5).tolist() == [i for i in range(3000) if i % 300 == 7]
    assert np.allclose(ranker.mean, x.mean(0)) and np.allclose(ranker.scale, x.std(0) + 1e-6)
    flipped = marks.withColumn("quality", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(F.col("quality")))
    ranker = quality.learn(id_text(docs(spark, *rows)), flipped, rows=40)
    assert (ranker.score(x) < 0.5).sum() == flipped.where("quality = 0").count()


def test_quality_cut_is_exact(spark, monkeypatch):
    draw = random.Random(8)
    monkeypatch.setattr(quality, "ACCURACY", 5)
    for values in ([draw.random() for _ in range(500)], [draw.randrange(9) / 4 for _ in range(60)], [1.0] * 5):
        frame, own = spark.createDataFrame([(v,) for v in values], "s double"), sorted(values)
        for k in {1, 2, len(own) // 3, len(own) - 1}:
            assert quality._cut(frame, k, len(own)) == pytest.approx((own[k - 1] + own[k]) / 2)


def test_toxicity_scores(spark, real, labels):
    got = toxicity.toxicity_scores(real, labels).toPandas().set_index("doc_id").score
    marks = labels.toPandas().set_index("doc_id").toxic
    assert ((got.loc[marks.index] >= 0.5) == (marks == 1)).mean() > 0.9 and got.between(0, 1).all()
    odd = collected(toxicity.toxicity_scores(docs(spark, *ODD), labels.where("doc_id < 0")), "doc_id", "score")
    assert len(odd) == len(ODD) and {s for _, s in odd} == {0.5}
    assert toxicity.toxicity_scores(docs(spark, *ODD).limit(0), labels).count() == 0


def test_log_count_ratios_equal_brute_force(spark, real, labels):
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    texts = {r.doc_id: r.text or "" for r in real.collect() if r.doc_id in marks}
    up, down = Counter(), Counter()
    for d, t in texts.items():
        raw = f" {t.lower()} ".encode()
        (up if marks[d] else down).update({raw[i : i + k] for k in toxicity.ORDERS for i in range(len(raw) - k + 1)})
    size = len({*up, *down})
    all_up, all_down = up.total() + size, down.total() + size
    want = {}
    for g in {*up, *down}:
        ratio = math.log((up[g] + 1) / all_up) - math.log((down[g] + 1) / all_down)
        if up[g] + down[g] >= max(4, toxicity.LEAST_SHARE * len(texts)) and ratio >= toxicity.EVEN:
            want[g] = ratio
    sample = id_text(real).join(labels.select("doc_id", F.col("toxic").alias("mark")), "doc_id").select("doc_id", "mark", "text")
    ids, ratio = toxicity.ratios(toxicity.counts(sample), len(texts))
    assert len(ids) == len(want) > 100 and np.allclose(np.sort(ratio), sorted(want.values()), rtol=1e-4)


@pytest.mark.parametrize(("score", "column"), [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_odd_rows_and_labels_with_a_fitted_model(spark, real, labels, score, column):
    """Odd rows get a score of their text; null labels, repeated ones and those of absent documents do no harm."""
    base = real.select("doc_id", "text").unionAll(docs(spark, *((i and i + 10**9, t) for i, t in ODD)).select("doc_id", "text"))
    other = spark.createDataFrame([(None, 1, 1), (10**9 + 3, None, None), (10**9 + 99, 0, 0)], "doc_id long, quality int, toxic int")
    more = labels.select("doc_id", "quality", "toxic").unionAll(labels.select("doc_id", "quality", "toxic").limit(20)).unionAll(other)
    plain = dict(collected(score(real, labels), "doc_id", "score"))
    got = collected(score(base, more), "doc_id", "score")
    assert len(got) == real.count() + len(ODD) and all(s is not None and 0 <= s <= 1 for _, s in got)
    odd = defaultdict(set)
    for d, s in got:
        odd[d].add(s)
    assert len(odd[10**9 + 3]) == 1 and odd[10**9 + 3] == odd[10**9 + 7] and odd[10**9 + 1] == odd[10**9 + 2]
    if score is toxicity.toxicity_scores:  # statistics of all documents, odd ones too, are quality's scales
        assert all(abs(next(iter(odd[d])) - s) < 1e-9 for d, s in plain.items())
    flipped = labels.withColumn(column, F.lit(None).cast("int"))
    assert {s for _, s in collected(score(real, flipped), "doc_id", "score")} == {0.5}


@pytest.mark.parametrize(("name", "column", "n", "held", "least"), [("op7_quality_ranking", "quality", 3, 1, 0.98), ("op10_toxicity", "toxic", 5, 0, 0.95)])
def test_held_out_accuracy(spark, name, column, n, held, least):
    sf = "/root/testdata/sf0.1"
    got = QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % n == held)).all()
    own = got[got.held_out]
    assert (own.predicted == own[column]).mean() >= least


def test_packing(spark):
    path = public_tokenizers.path(packing.TOKENIZER)
    known = Tokenizer.from_file(path)
    rows = [*ODD, (20, "word " * 5000), (21, "the end")]
    got = collected(packing.pack(id_text(docs(spark, *rows)), path), "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    want = []
    for i, t in rows:
        ids = [*known.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or min(2048, len(ids)), len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((g[:5] for g in got), key=repr) == sorted(want, key=repr)
    by = defaultdict(list)
    for *_, n, _, s, at in got:
        by[s].append((at, n))
    for spots in by.values():
        end = 0
        for at, n in sorted(spots):
            assert at == end
            end += n
        assert end <= 2048
    assert packing.pack(id_text(docs(spark, *rows).limit(0)), path).count() == 0


def test_extendible_hashing(spark):
    rows = [(i, "x" * (i % 50)) for i in range(400)] + [(7, "y" * 90), (None, "z"), (None, None), (900, "w" * 5000)] + [(901, "v" * 30)] * 40
    got = collected(sharding.assign(docs(spark, *rows), limit=300, step=2), "doc_id", "bytes", "depth", "prefix", "page")
    assert Counter((i, n) for i, n, *_ in got) == Counter((i, len(t or "")) for i, t in rows)
    key = lambda d: int(hashlib.md5(str("" if d is None else d).encode()).hexdigest()[:15], 16)
    size, ids = Counter(), defaultdict(set)
    for i, n, depth, prefix, page in got:
        assert key(i) >> (60 - depth) == prefix
        size[depth, prefix, page] += n
        ids[depth, prefix].add(i)
    assert all(n <= 300 or page and n or len(ids[d, p]) == 1 for (d, p, page), n in size.items())
    assert max(n for (d, p, _), n in size.items() if 900 not in ids[d, p]) <= 300
    total = Counter()
    for i, t in rows:
        for d in range(61):
            total[d, key(i) >> (60 - d)] += len(t or "")
    for d, p in ids:  # no shard is split that fits as a whole
        assert d == 0 or total[d - 1, p >> 1] > 300
    assert sharding.assign(docs(spark, *rows).limit(0)).count() == 0


def test_pipeline_stages(spark, real, labels):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near duplicates", "decontamination", "packing"]
    frame, seen = real, [real.count()]
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, frame, SF)
        assert out.columns == real.columns and out.join(frame, "doc_id", "left_anti").count() == 0
        frame = spark.createDataFrame(out.toPandas(), real.schema)
        seen.append(frame.count())
    assert seen == sorted(seen, reverse=True) and seen[0] > seen[1] > seen[2] > seen[3] >= seen[4] > 0
    marks = labels.join(frame, "doc_id").agg(F.avg("quality"), F.avg("toxic")).first()
    assert marks[0] > 0.95 and marks[1] < 0.05
    assert len(set(brute_classes([tuple(r) for r in frame.select("doc_id", "text").collect()]).values())) == seen[4]
    assert decontaminate.contaminated(frame, read_table(spark, SF, "benchmark")).count() == 0
    packed = collected(corpus_pipeline.run(spark, SF), "doc_id", "length")
    assert {d for d, _ in packed} == {r[0] for r in collected(frame, "doc_id")}


def test_pipeline_keeps_odd_rows(spark):
    rows = docs(spark, *ODD, (8, "short"))
    kept = corpus_pipeline.neardup_stage(spark, rows, SF)
    assert kept.columns == rows.columns
    assert sorted(collected(kept, "doc_id"), key=repr) == sorted([(1,), (3,), (5,), (None,)], key=repr)
    # an id with two texts: what has no duplicate stays
    texts = {x: " ".join(f"{x}{k}" for k in range(20)) for x in "ab"}
    for ids in ((1, 5, 5), (7, 7)):
        rows = docs(spark, *zip(ids, "aab" if len(ids) == 3 else "ab", strict=True)).withColumn("text", F.when(F.col("text") == "a", texts["a"]).otherwise(texts["b"]))
        kept = collected(corpus_pipeline.neardup_stage(spark, rows, SF), "doc_id", "text")
        assert sorted(kept) == sorted([(ids[0], texts["a"]), (ids[-1], texts["b"])])
    rows = docs(spark, *ODD, (8, "short"))
    assert corpus_pipeline.neardup_stage(spark, rows.limit(0), SF).count() == 0


def test_pipeline_stages_take_odd_rows_and_empty_tables(spark, real, labels):
    odd = [*ODD, (5, "another text of the same id"), (9, "word " * 30), (9, "word " * 30)]
    frame = real.unionAll(spark.createDataFrame([(i, t, None, None, None) for i, t in odd], real.schema))
    marks = {name: stage for name, stage in corpus_pipeline.STAGES}
    for name in ("quality", "toxicity", "decontamination"):
        out = marks[name](spark, frame, SF)
        assert out.schema.names == real.schema.names and 0 < out.count() < frame.count()
        # a row's fate follows from its text
        kept, gone = {r.text or "" for r in out.collect()}, {r.text or "" for r in frame.exceptAll(out).collect()}
        assert kept.isdisjoint(gone) and {""} <= kept | gone
        assert marks[name](spark, frame.limit(0), SF).count() == 0
    assert marks["packing"](spark, frame, SF).select("doc_id").where("doc_id is null").count() == 1
    assert marks["packing"](spark, frame.limit(0), SF).count() == 0
