"""Language ID, toxicity, quality rules, token counts, packing and licences on small and odd inputs."""
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paytide.llm import langid, licenses, packing, quality, tokencount, toxicity

LONG = "the and of long " * 6000
ODD = [(1, "The cat and the dog of the house"), (2, None), (3, ""), (4, "  \t\n "), (5, LONG), (6, "123 !!! 456"), (None, "no id here at all"),
       (7, "ties ties ties"), (7, "ties ties ties"), (8, "<|endoftext|> 日本語 I'm İstanbul ΑΣ")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns whose names the operators use."""
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("lang", F.lit("en"))
    return df.withColumns({c: F.lit("x") for c in ("score", "kept", "n_tokens", "toxic", "piece", "length", "digest", "form", "t", "key")})


def test_parse_is_greedy_longest_match():
    model = langid.Model({"a": "abcabcab dcab", "b": "zzz yx", "c": "日本日中 ёж"}).built()
    for k, name in enumerate(model.names):
        text = model.coded([model.texts[name]])[0].tolist()
        for probe in ("abca dab", "zzab", "b", "dcabcabc", "日本 abc 中ж", "q" * 30, "ab" * 700):
            (got, lacking), _, lettered = model.phrases([probe])
            codes = model.coded([probe])[0].tolist()
            n = 0
            for i in range(0, len(codes), langid.BLOCK):
                todo = codes[i:i + langid.BLOCK]
                while todo:
                    fits = (m for m in range(len(todo), 0, -1) if any(text[j:j + m] == todo[:m] for j in range(len(text))))
                    todo, n = todo[max(next(fits, 0), 1):], n + 1
            assert got[0, k] == n and lettered[0] and lacking[0, k] == sum(c not in text for c in codes)


SCRIPTS = {"ru": (0x430, 32), "bg": (0x430, 30), "el": (0x3B1, 24), "hi": (0x905, 50), "zh": (0x4E00, 3000), "ja": (0x3041, 80), "ko": (0xAC00, 1500), "en": (97, 26), "ar": (0x627, 28)}


def made_up(names, per, words, seed=5):
    """Texts of made-up words of each language's own syllables."""
    rng = np.random.default_rng(seed)
    out = []
    for name in names:
        first, n = SCRIPTS.get(name, (97, 26))
        letters = [c for c in map(chr, range(first, first + n)) if c.isalpha()]
        syllables = ["".join(rng.choice(letters, 2)) for _ in range(60)]
        out += [(name, " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(words))) for _ in range(per)]
    return out


def test_language_of_many_scripts(spark):
    rows = [(i, *r) for i, r in enumerate(made_up(SCRIPTS, 80, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = langid.identify(docs.filter("doc_id % 2 = 1"), langid.learn(docs.filter("doc_id % 2 = 0")))
    right = {r["lang"]: r["right"] for r in got.groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).collect()}
    assert set(right) == set(SCRIPTS) and min(right.values()) > 0.95


def test_language_of_300_labels(spark):
    rows = [(i, *r) for i, r in enumerate(made_up([f"l{i:03d}" for i in range(300)], 8, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.learn(docs.filter("doc_id % 2 = 0"))
    assert len(model.names) == 300
    got = langid.identify(docs.filter("doc_id % 2 = 1").repartition(2), model)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_language_of_odd_texts(spark, odd):
    rows = {(r["doc_id"], r["lang_pred"]): r for r in langid.identify(odd, langid.learn(odd)).collect()}
    assert (2, "und") in rows and (3, "und") in rows and (4, "und") in rows and (6, "und") in rows and (1, "en") in rows
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and rows[(1, "en")]["n_tokens"] == "x"
    none = odd.filter("doc_id > 100")
    assert langid.identify(none, langid.learn(none)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.learn(none)).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out(F.col("doc_id")))
    got = langid.identify(docs.filter("held_out"), langid.learn(docs.filter("NOT held_out"))).filter("n_chars > 50")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_toxic_chain(spark):
    rows = [(i, f"the {'idiot' if i % 4 == 0 else 'worp' + 'abcd'[i % 3] if i % 4 == 1 else 'house'} number n{i} of the street") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.filter("doc_id < 300").select("doc_id", (F.col("doc_id") % 4 < 2).cast("int").alias("toxic"))
    chain = toxicity.fit(docs, labels.union(labels))
    held = toxicity.judge(docs.filter("doc_id >= 300"), chain).collect()
    assert all(r["toxic"] == (r["doc_id"] % 4 < 2) for r in held)
    assert all((r["p_explicit"] > 0.5) == (r["doc_id"] % 4 == 0) and (r["p_coded"] > 0.5) == (r["doc_id"] % 4 == 1) for r in held)


def test_toxicity_of_long_texts(spark):
    """Long clean texts of joined clean documents stay clean, and the same texts with a toxic passage do not."""
    sf = "/root/testdata/sf0.01/"
    docs, labels = spark.read.parquet(f"{sf}documents.parquet").select("doc_id", "text", "lang"), spark.read.parquet(f"{sf}labels.parquet")
    fitted = toxicity.fit(docs.select("doc_id", "text"), labels)
    clean = docs.filter("lang = 'en'").join(labels.filter("toxic = 0").select("doc_id"), "doc_id").orderBy("doc_id").select("text").collect()
    pool = [w for r in clean for w in r["text"].split()]
    insult = "you stupid idiot what a pathetic loser worthless trash and scum you moron"
    texts = [(i, " ".join((pool[i * 997:] + pool)[:20_000])) for i in range(4)]
    rows = texts + [(10 + i, f"{t[:30_000]} {insult} {t[30_000:]}") for i, t in texts]
    rows += [(20, " ".join(pool[:256])), (21, "z" * 300_000), (22, " ".join(pool[:300]) + " " + insult)]
    got = {r["doc_id"]: r["toxic"] for r in toxicity.judge(spark.createDataFrame(rows, "doc_id long, text string"), fitted).collect()}
    assert got == {i: i in (10, 11, 12, 13, 22) for i, _ in rows}


def test_halves_cover_all_words():
    for n in (0, 1, 127, 128, 129, 160, 256, 300, 5_001):
        tokens = [f"w{i}" for i in range(n)]
        halves = toxicity.halved(" ".join(tokens))
        assert [t for h in halves for t in h] == tokens and all(64 <= len(h) < 192 for h in halves[1:])
    assert toxicity.halved("x" * 450) == [["x" * 200, "x" * 200, "x" * 50]] and toxicity.halved(None) == []


def test_toxicity_of_odd_texts(spark, odd):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.judge(odd, toxicity.fit(odd, labels)).collect()
    assert len(got) == len(ODD) and all(isinstance(r["toxic"], bool) and r["score"] == "x" for r in got)
    nothing = toxicity.fit(odd, labels.filter("toxic > 1"))
    assert not any(r["toxic"] for r in toxicity.judge(odd, nothing).collect())
    assert toxicity.judge(odd.filter("false"), nothing).count() == 0


def _repeats(ws):
    at = {}
    for i in range(len(ws) - 7):
        at.setdefault(tuple(ws[i:i + 8]), []).append(i)
    return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)})


def test_quality_counts(spark, odd):
    texts = [t for _, t in ODD] + ["a b c d e f g h " * 2 + "x", "one\ntwo\none\n \none", "p q r s t u v w x p q r s t u v w y z"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in quality.judge(docs).collect():
        ws = "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in texts[r["doc_id"]] or "").split(" ")
        ws = [w for w in ws if w]
        assert r["n_words"] == len(ws) and r["word_chars"] == sum(map(len, ws)) and r["n_repeat_words"] == _repeats(ws)
        assert r["base_failed"] == (len(ws) < 20 or 100 * _repeats(ws) > 30 * len(ws))
    assert quality.judge(docs).filter("doc_id = 11").first()["n_dup_lines"] == 2
    got = quality.judge(odd).collect()
    assert len(got) == len(ODD) and not [r for r in got if r["doc_id"] == 2][0]["kept"] and got[0]["score"] == "x"
    assert quality.judge(odd.filter("false")).count() == 0
    assert quality.judge(docs.withColumn("lang", F.lit(None).cast("string"))).filter("class_distance IS NOT NULL").count() == 0


def test_js_distance(spark):
    r = spark.range(1).select(
        quality.js_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("far"),
        quality.js_distance(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5))).alias("same")).first()
    assert r["far"] == pytest.approx(1) and r["same"] == 0


def test_token_counts_equal_the_library(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [t for _, t in ODD] + ["It's 1234 <|startoftext|> <|ENDOFTEXT|>", "e\u0301cole École", "a\u00a0b\u2028c\x1cd", "''s don't I'LL", "ſß ǅ"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in tokencount.count_tokens(docs, path).collect():
        t = texts[r["doc_id"]] or ""
        assert r["n_tokens"] == len(library.encode(t, add_special_tokens=False).ids) and r["n_bytes"] == len(t.encode())
        assert r["over_limit"] == (r["n_tokens"] > 2048)
    got = tokencount.count_tokens(odd, path)
    assert got.count() == len(ODD) and got.filter("score = 'x'").count() == len(ODD)
    assert tokencount.count_tokens(odd.filter("false"), path).count() == 0


def test_token_counts_of_other_scripts_use_the_lookup(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens, library, asked = tokencount.Tokens(path), Tokenizer.from_file(path), []
    whole = tokens.whole
    monkeypatch.setattr(tokens, "whole", lambda t: asked.append(t) or whole(t))
    texts = ["“quotes” — and – dashes… 5 €", "Привет, МИР! Ёлка", "ΟΔΥΣΣΕΥΣ ΑΣ. ΣΑΣ", "日本語のテキスト 中文字", "한국어 문장", "😀👍🏽 ok 👩‍👩‍👧", "हिन्दी में ३ शब्द",
             "e\u0301cole İI ıi ǅ ſß", "a\u2028b\u00a0c\u3000d\x85e\x1cf", "<|x|> <| endoftext |> <|ENDOFTEXT|>", "it's ДON'T we’ll 'S", "", " \t\n"]
    assert [tokens.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert not asked
    assert tokens.count("я <|endoftext|> я") == len(library.encode("я <|endoftext|> я", add_special_tokens=False).ids) and len(asked) == 1


def _check_packing(rows, texts, capacity):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(tuple(library.encode(t or "", add_special_tokens=False).ids) + (0,) for t in texts)
    whole = {}
    for r in rows:
        whole.setdefault((r["doc_id"], r["nth"] if "nth" in r else 0), []).append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) and len(r["ids"]) == r["length"] <= capacity
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= capacity
    assert sum(len(w) for w in want) == sum(r["length"] for r in rows)
    return bins, want


def test_packing_of_odd_texts(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [r.asDict() for r in packing.pack(odd, path, capacity=64, keep_ids=True).collect()]
    _check_packing(rows, [t for _, t in ODD], 64)
    cut = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 5)
    assert [s for _, s, _ in cut] == [sum(n for _, _, n in cut[:i]) for i in range(len(cut))]
    assert all(n == 64 for _, _, n in cut[1:])
    assert all(len([r for r in rows if r["doc_id"] == i]) == 1 for i in (2, 3))
    assert packing.pack(odd.filter("false"), path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_fills_sequences(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.choice(np.r_[1:2049], size=3000, p=np.r_[2048:0:-1] / (2048 * 2049 / 2))
    values, counts = np.unique(sizes, return_counts=True)
    plan = packing.Plan(dict(zip(values.tolist(), counts.tolist(), strict=True)))
    assert plan.taken == {int(v): int(c) for v, c in zip(values, counts, strict=True) if v < 2048} | ({2048: plan.taken[2048]} if 2048 in plan.taken else {})
    bound = -(-int(sizes.sum()) // 2048)
    assert bound <= plan.sequences <= bound * 1.02 + 2


def test_license_forms(spark):
    mit = licenses.LICENSES["MIT"]
    rows = [(1, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENCE")), (2, "words\nReleased under the MIT licence\nLicensed under CC BY-NC 4.0!"),
            (3, None), (4, ""), (5, "Some text that nobody licensed"), (6, mit + " and more"), (7, "* SPDX-License-Identifier: MIT"), (7, "* SPDX-License-Identifier: MIT"), (None, "Licensed under CC BY 4.0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit(1), "form": F.lit(2), "key": F.lit(3)})
    got = {}
    for r in licenses.scan(docs, licenses.known(spark)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[1][0]["license_id"] == "MIT" and got[2][0]["license_id"] is None
    assert got[2][0]["line_licenses"] == ["notice:CC-BY-NC-4.0", "notice:MIT"]
    assert got[3][0]["text_digest"] is None and got[4][0]["text_digest"] is None and got[5][0]["license_id"] is None and got[6][0]["license_id"] is None
    assert [r["license_id"] for r in got[7]] == ["spdx:MIT"] * 2 and got[None][0]["license_id"] == "notice:CC-BY-4.0"
    assert licenses.scan(docs.filter("false"), licenses.known(spark)).count() == 0


def test_license_files(spark):
    end = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
    grant = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"
    isc = f"{grant}, provided that the above\ncopyright notice and this permission notice appear in all copies.\n{end}"
    mit, bsd2, bsd3 = (licenses.LICENSES[k].replace("above copyright", "above\ncopyright").replace("OR COPYRIGHT", "OR\nCOPYRIGHT") for k in ("MIT", "BSD-2-Clause", "BSD-3-Clause"))
    apache = licenses.full_texts()["Apache-2.0"]
    texts = [("ISC", f"ISC License\n\nCopyright (c) 2020, Some Body\n\n{isc}"), ("ISC", f"Copyright 2020 Some Body\n\n{isc}"), ("ISC", isc),
             ("0BSD", f"Zero-Clause BSD\n\n{grant}.\n{end}"), ("MIT", f"MIT License\n\nCopyright (c) [year] [fullname]\n\n{mit}"),
             ("MIT", f"The MIT License (MIT)\n\nCopyright The Some Authors\nAll rights reserved.\n\n{mit}"), ("BSD-2-Clause", f"BSD 2-Clause License\n\n© Some Body\n{bsd2}"),
             ("BSD-3-Clause", f"BSD 3-Clause \"New\" or \"Revised\" License\n\n(c) Some Body\n\n{bsd3}"), ("Apache-2.0", " ".join(apache.split("\n   "))),
             (None, "MIT License"), (None, f"Some other words\n{isc}"), *[(k, v) for k, v in licenses.full_texts().items()]]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(docs, licenses.known(spark)).collect()}
    assert got == {i: k for i, (k, _) in enumerate(texts)}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"} <= set(got.values())
