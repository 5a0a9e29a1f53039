import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnflow.llm.tokens import LENGTH, MODEL, CapacityTree, Vocabulary, best_fit_decreasing, pack, with_token_counts, write_packed

TEXTS = ["", None, " ", "  ", "a  b", "a \n\n b\n", " \n ", "\n", "<s> </s><0x0A>", "▁▁x▁", "é̀ 　x\t\r\n", "x" * 7000, "日本語 テスト🎉", "the cat sat. " * 500]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))


def test_counts_equal_the_library(spark):
    sp = library()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    rows = {r.doc_id: r for r in with_token_counts(df).collect()}
    for i, t in enumerate(TEXTS):
        assert rows[i].n_tokens == len(sp.encode(t or "")) and rows[i].n_bytes == len((t or "").encode())
    assert with_token_counts(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é▁\n\t.,日 "), max_size=40))
def test_pre_tokens_add_up(text):
    v = test_pre_tokens_add_up.__dict__.setdefault("v", Vocabulary())
    assert v.count([text]) == [len(v.sp.encode(text))]
    assert np.frombuffer(v.encode([text])[0], "<u2").tolist() == v.sp.encode(text)


def test_chunks_of_texts_equal_the_library():
    v = Vocabulary()
    for t in [*TEXTS, "a\n b", "\na", "a \nb ", "x\n\n\ny", " lead", "▁a\nb", "a  b\nc", "tail "]:
        assert np.frombuffer(v.encode([t or ""])[0], v.kind).tolist() == v.sp.encode(t or "")
    assert v.kind == "<u2"


def test_packing_of_repeated_rows_null_ids_and_extra_columns(spark):
    sp = library()
    df = spark.createDataFrame([(1, "one two", "x"), (1, "one two", "y"), (None, "three", "x"), (2, None, None)], "doc_id long, text string, pack string")
    found = sorted(((d, p.input_ids[2 * a : 2 * b]) for p in pack(df, length=64).collect() for d, a, b in zip(p.doc_ids, p.cu_seqlens, p.cu_seqlens[1:])), key=str)
    two = np.array(sp.encode("one two"), "<u2").tobytes()
    assert found == sorted([(1, two), (1, two), (None, np.array(sp.encode("three"), "<u2").tobytes())], key=str)


def test_packing_is_lossless(spark, tmp_path):
    sp = library()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    packed = pack(df, length=64)
    write_packed(packed, f"{tmp_path}/packed")
    docs = {}
    for p in spark.read.parquet(f"{tmp_path}/packed").collect():
        ids = np.frombuffer(p.input_ids, "<u2")
        assert len(ids) == 64 and p.cu_seqlens[0] == 0 and p.cu_seqlens[-1] == p.n_tokens and p.position_resets == p.cu_seqlens[:-1]
        for n, (doc, start) in enumerate(zip(p.doc_ids, p.doc_starts)):
            docs.setdefault(doc, {})[start] = ids[p.cu_seqlens[n] : p.cu_seqlens[n + 1]].tolist()
    for i, t in enumerate(TEXTS):
        assert [x for _, part in sorted(docs.get(i, {}).items()) for x in part] == sp.encode(t or "")
    assert pack(df.limit(0)).count() == 0 and LENGTH == 2048


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_best_fit_decreasing(sizes):
    bins = best_fit_decreasing(sizes, 20)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    # Brute force: the fullest bin that has room.
    rooms = []
    for x in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(20 - x)
    assert sorted(20 - sum(sizes[i] for i in b) for b in bins) == sorted(rooms)


def test_tree_finds_the_least_room():
    tree = CapacityTree(10)
    for n, room in enumerate((3, 7, 5)):
        tree.put(n, room)
    assert tree.take(4) == (2, 5) and tree.take(4) == (1, 7) and tree.take(4) is None and tree.take(1) == (0, 3)
