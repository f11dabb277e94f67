import numpy as np

from irforge.llm import language_id as li
from tests.llm.rows import docs_frame, edge_docs
from tests.conftest import SF_CHECK

WORDS = {"en": "the of and that with this they have from which".split(), "fr": "les des une dans que pour avec sont être leurs".split(), "el": "και του της στην που από είναι για".split()}


def text(rng, share, n=80):
    return " ".join(rng.choice(WORDS[rng.choice(list(share), p=list(share.values()))]) for _ in range(n))


def model():
    rng = np.random.default_rng(1)
    counts = np.zeros((3, li.SLOTS))
    for k, lang in enumerate(sorted(WORDS)):
        slot, _, _ = li.word_slots([text(rng, {lang: 1.0}, 5000)])
        counts[k] = np.bincount(slot, minlength=li.SLOTS)
    return li.LanguageModel(sorted(WORDS), counts)


def test_mixtures_and_language_sets():
    rng, m = np.random.default_rng(2), model()
    for share in ({"en": 1.0}, {"fr": 0.7, "en": 0.3}, {"el": 0.5, "en": 0.3, "fr": 0.2}):
        for _ in range(10):
            lang, score = m.predict([text(rng, share, 300)])
            top = max(share, key=share.get)
            assert lang == [top] and abs(score[0] - share[top]) < 0.12
    assert m.predict([text(rng, {"fr": 1.0}, 50)]) == (["fr"], [1.0])


def test_em_equals_direct_maximum():
    rng = np.random.default_rng(3)
    like = rng.random((200, 2)) ** 3
    share, value = li.em(like, 500)
    grid = np.linspace(0.001, 0.999, 999)
    direct = [np.log(like @ np.array([g, 1 - g])).sum() for g in grid]
    assert abs(grid[int(np.argmax(direct))] - share[0]) < 0.01 and value >= max(direct) - 0.01


def test_no_letters_and_batches():
    m = model()
    texts = [None, "", "123 !? \n", "the", "\n\nthe\n", "Ünï 中文 και", "the " * 20000]
    lang, score = m.predict(texts)
    assert lang[:3] == ["und"] * 3 and score[:3] == [0.0] * 3 and lang[3] == lang[4] == lang[6] == "en"
    assert ([x for t in texts for x in m.predict([t])[0]], [x for t in texts for x in m.predict([t])[1]]) == (lang, score)
    assert all(0 <= s <= 1 for s in score)
    assert li.LanguageModel([], np.zeros((0, li.SLOTS))).predict(["the"]) == (["und"], [0.0])


def test_letters_equal_isalpha():
    code = np.arange(1, 0x3000, dtype=np.uint32)
    assert li.is_letter(code).tolist() == [chr(c).isalpha() for c in code.tolist()]


def test_held_out_accuracy(spark):
    import zlib
    out = li.op2_language_id(spark, SF_CHECK).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out) and len(out) == len(lang)
    held = [r for r in out if r.held_out]
    assert len(held) > 100 and np.mean([lang[r.doc_id] == r.lang_pred for r in held]) > 0.97


def test_edge_rows_and_empty_tables(spark, tmp_path):
    rows = edge_docs()
    docs_frame(spark, rows, score="clash", p=1, held_out=2).write.parquet(str(tmp_path / "documents.parquet"))
    out = li.op2_language_id(spark, str(tmp_path)).collect()  # no language is known
    assert len(out) == len(rows) and {(r.lang_pred, r.score) for r in out} == {("und", 0.0)}
    assert [r.held_out for r in out if r.doc_id is None] == [False, False]
    docs_frame(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert li.op2_language_id(spark, str(tmp_path / "none")).count() == 0
