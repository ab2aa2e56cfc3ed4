import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm import queries
from granary.llm.bpe import NEW_CAPITALS, UNKNOWN_YET, BpeCodec, decode_documents, encode_documents, load
from granary.llm.common import held_out
from granary.llm.language_id import UNKNOWN, LanguageModel, Predictor, fit_languages, parts, with_language
from granary.llm.toxicity import ToxicityModel, fit_toxicity, maximal_segments, with_toxicity

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "aaaaaaaaa", "Hello  World's <|endoftext|>x<|startoftext|> İΣΑΣ fooÉ é 12 x\x1cy\x85z", "日本語テスト", "a" * 5001, "ab" * 3000, "don't I'LL we've '''s", "①②½ ﬁ", "<|EndOfText|>", "\x00\x01", "ẞ ß", "...!!!???",
    " ".join(f"word{k} and" for k in range(3000)),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_codec_encodes_and_decodes_as_the_library_does(library):
    rnd = random.Random(5)
    texts = ODD + ["".join(rnd.choice("abcdeé ßñ.,'!0123\n\tABC") for _ in range(rnd.randint(1, 200))) for _ in range(300)]
    codec = BpeCodec(load(PATH), most=50_000)
    ids = codec.encode(texts, together=2000)
    for text, own, theirs in zip(texts, ids, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.tolist() == theirs.ids, text[:80]
    assert codec.decode(ids) == [library.decode(x.tolist(), skip_special_tokens=False) for x in ids]


def test_code_points_that_unicode_tables_differ_on(library):
    points = [c for a, b in re.findall(r"(\\[uU][0-9a-f]+)(?:-(\\[uU][0-9a-f]+))?", UNKNOWN_YET) for c in (int(a[2:], 16), int((b or a)[2:], 16))] + list(NEW_CAPITALS) + list(NEW_CAPITALS.values())
    texts = [form.format(chr(c)) for c in points for form in ("{}", "a{}b", "a{0}{0} 1{0}", "\u00e9{}\u0301")]
    for text, own, theirs in zip(texts, BpeCodec(load(PATH)).encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.tolist() == theirs.ids, ascii(text)


def test_bpe_keeps_rows_and_columns(spark, library):
    df = spark.createDataFrame([(k, t, 7) for k, t in enumerate([*ODD, None, "same", "same"])], "doc_id int, text string, ids int")
    rows = decode_documents(encode_documents(df, PATH), PATH).collect()
    assert len(rows) == df.count() and all(r.ids == library.encode(r.text or "", add_special_tokens=False).ids for r in rows)
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in rows)
    assert encode_documents(df.limit(0), PATH).collect() == []
    packed = encode_documents(df, PATH, ids_col="packed", decoded_col="_text", packed=True, keep=["doc_id"]).collect()
    plain = {r.doc_id: r for r in rows}
    assert all(np.frombuffer(r.packed, "<u4").tolist() == plain[r.doc_id].ids and r["_text"] == plain[r.doc_id].decoded for r in packed)
    assert packed[0].__fields__ == ["doc_id", "packed", "_text"]


TRAIN = [("en", "the cat and the dog that ran"), ("en", "this and that of the house"), ("fr", "le chat et la maison des amis"), ("fr", "une petite maison avec les chats")]


def test_language_of_words_backoff_and_texts_without_letters(spark):
    df = spark.createDataFrame([(k, t, lang, 0.5) for k, (lang, t) in enumerate(TRAIN)] + [(9, "x", None, 0.5)], "doc_id long, text string, lang string, score double")
    model = fit_languages(df)
    assert model.langs == ["en", "fr"]
    asked = [("the that", "en"), ("thats thing", "en"), ("maisons chattes", "fr"), (None, UNKNOWN), ("", UNKNOWN), ("12 ... _ ²", UNKNOWN), ("THE " * 50_000, "en")]
    rows = with_language(spark.createDataFrame([(k, t, "q") for k, (t, _) in enumerate(asked)], "doc_id int, text string, lang_pred string"), model).collect()
    assert [r.lang_pred for r in sorted(rows)] == [want for _, want in asked]
    assert all(0 <= r.score <= 1 for r in rows) and all((r.score == 0) == (r.lang_pred == UNKNOWN) for r in rows)
    empty = fit_languages(df.limit(0))
    assert with_language(df, empty).first().lang_pred == UNKNOWN and with_language(df.limit(0), model).collect() == []


def test_a_rare_language_stays_beside_a_frequent_one(spark):
    rnd = random.Random(12)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(5))
    hot = [word("abcdefgh") for _ in range(400)]
    rows = [(k, " ".join(rnd.choice(hot) for _ in range(30)), "hot") for k in range(600)] + [(1000, "qrstu vwxyz qxyzu", "rare"), (1001, "rstuv", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for how in ({}, {"max_docs": 20}):
        model = fit_languages(df, **how)
        assert model.langs == ["hot", "rare"]
        assert Predictor(model).predict("vwxyz qrstu")[0] == "rare" and Predictor(model).predict(rows[0][1])[0] == "hot"
    assert parts({"a": 1, "b": 50, "c": 7}, 20) == {"a": 1, "b": 12, "c": 7} and parts({"a": 3}, 20) == {"a": 3}


def test_unseen_words_fall_back_to_the_longest_known_grams():
    model = LanguageModel.fit([("a", "abcde", 5), ("b", "xyz", 5)])
    assert model.scores(["abcd", "xyzz"]).argmax(axis=1).tolist() == [0, 1]
    assert Predictor(model, most=2).predict("abcd xyzq abce abcf")[0] == "a"


def slow_language(model, text):
    """A text's language word by word, without any table of words met."""
    import re

    total, n = np.zeros(len(model.langs)), 0
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        if w in model.words:
            total += model.logs[model.words[w]]
        else:
            marked, at, found = f"<{w}>", 0, []
            while at < len(marked):
                size = next((s for s in (5, 4, 3, 2, 1) if at + s <= len(marked) and marked[at : at + s] in model.grams), 0)
                if size:
                    found.append(model.logs[model.grams[marked[at : at + size]]])
                at += size or 1
            if found:
                total += np.mean(found, axis=0)
        n += any(c.isalpha() for c in w)
    if not n:
        return UNKNOWN, 0.0
    x = np.exp((total - total.max()) / np.sqrt(n))
    return model.langs[int(np.argmax(total))], float(x.max() / x.sum())


def test_query_op3_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_languages(docs.filter(~held_out(F.col("doc_id"))))
    want = {r.doc_id: slow_language(model, r.text) for r in docs.collect()}
    rows = queries.QUERIES["op3_language_id"](spark, SF).collect()
    assert len(rows) == len(want) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-3 for r in rows)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id]]) > 0.95


def slow_segments(scores, offset=0):
    """The best segment, shortest first among equals, then the same to its left and right."""
    best = max(((sum(scores[i:j]), i - j, -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i, j = -best[2], -best[2] - best[1]
    return slow_segments(scores[:i], offset) + [(offset + i, offset + j, best[0])] + slow_segments(scores[j:], offset + j)


def test_maximal_segments_equal_the_recursive_definition():
    rnd = random.Random(6)
    for k in range(400):
        scores = [rnd.uniform(-3, 3) for _ in range(rnd.randint(0, 14 if k % 4 else 40))]
        got, want = maximal_segments(scores), slow_segments(scores)
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want]), scores


def test_segment_search_takes_time_in_proportion_to_the_text():
    for unit in ([1.0, -2.0], [2.0, -1.0], [1.0, -1.5, 2.0, -3.0]):
        began = time.process_time()
        maximal_segments(unit * 500_000)
        assert time.process_time() - began < 5


def test_query_op9_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    m = fit_toxicity(docs, labels.filter(~held_out(F.col("doc_id"))))
    rows = {r.doc_id: r for r in queries.QUERIES["op9_toxicity"](spark, SF).collect()}
    short = [r for r in docs.collect() if len(r.text or "") < 1200]
    assert len(rows) == docs.count() and len(short) > 50
    for r in short:
        x = m.tokens(r.text)
        bits = [m.rate * s - m.log_k - np.log(len(x)) for _, _, s in slow_segments(x.tolist())]
        real = [b for b in bits if b > 0]
        a, b, c = m.curve
        want = 1 / (1 + np.exp(-(a + b * np.log1p(max(real, default=0)) + c * np.log1p(sum(real)))))
        assert abs(rows[r.doc_id].score - want) < 1e-6 and rows[r.doc_id].predicted == int(want >= 0.5)


def test_stretches_between_scoring_tokens_give_the_same_segments():
    rnd = random.Random(7)
    m = ToxicityModel(rate=1.0)
    for _ in range(100):
        x = np.array([rnd.choice([-0.3, -0.3, -1.0, 2.0, 0.7]) for _ in range(rnd.randint(1, 40))])
        assert [s[:2] for s in m.segments(x)] == [s[:2] for s in maximal_segments(x.tolist())]


def test_toxicity_learns_marks_passages_and_takes_odd_rows(spark):
    rnd = random.Random(8)
    words = ["tree", "house", "river", "stone", "cloud", "grass", "road", "bird"]
    rows = []
    for k in range(400):
        text = [rnd.choice(words) for _ in range(40)]
        if k % 4 == 0:
            text[10:12] = ["moron", "scum"]
        rows.append((k, " ".join(text), int(k % 4 == 0), "c"))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, toxic_score string")
    model = fit_toxicity(df, df.filter("doc_id < 300").unionByName(spark.createDataFrame([(None, "x", 1, "c"), (999, "y", None, "c")], df.schema)))
    asked = df.filter("doc_id >= 300").unionByName(spark.createDataFrame([(900, None, 0, ""), (901, "", 0, ""), (902, "bird " * 40000 + "moron scum", 1, "")], df.schema))
    got = with_toxicity(asked, model).collect()
    assert np.mean([(r.toxic_score >= 0.5) == bool(r.toxic) for r in got]) > 0.97
    assert all(0 <= r.toxic_score <= 1 for r in got)
    assert all("moron scum" in r.text[r.toxic_spans[0].begin : r.toxic_spans[0].end] for r in got if r.toxic and r.toxic_spans)
    none = fit_toxicity(df, df.limit(0))
    assert with_toxicity(df.limit(2), none).first().toxic_spans == [] and with_toxicity(df.limit(0), model).collect() == []
