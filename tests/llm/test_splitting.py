from hypothesis import given, settings
from hypothesis import strategies as st

from lodelens.llm import splitting as S


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n\r\té", max_size=900), st.integers(40, 120), st.integers(0, 19))
def test_pieces_cover_overlap_and_fit(text, limit, overlap):
    spans = S.split_spans(text, limit, overlap)
    assert "".join(text[a:b] if i == 0 else text[spans[i - 1][1] : b] for i, (a, b) in enumerate(spans)) == text
    assert all(0 < b - a <= limit for a, b in spans)
    for (a, b), (x, y) in zip(spans, spans[1:]):
        assert overlap <= b - x <= overlap + overlap // 2 and y > b and x > a


def test_natural_cuts_and_extremes():
    text = "\n\n".join(f"def f{i}():\n" + "    x = 1\n" * 12 for i in range(12))
    assert all(text[a:].startswith("def") or a == 0 for a, _ in S.split_spans(text, 500, 0))
    for t in ("x" * 50_000, "\n" * 5000, "a b " * 20_000):
        assert all(b - a <= 1920 for a, b in S.split_spans(t, 1920, 240))


def test_operator_on_dirty_rows(spark):
    long = "\r\n".join(f"line {i} of the text" for i in range(300))
    rows = [("p", "1", long, 11, 310, 5), ("p", "1", long, 11, 310, 5), ("p", "2", long, None, 9, None), ("p", "3", "short", 1, 1, 1), ("p", "4", None, 1, 1, 1), (None, "5", "", 1, 1, 1), ("p", "6", long, 500, 3, None)]
    df = spark.createDataFrame(rows, "project_id string, chunk_id string, text string, start_line int, end_line int, token_estimate int")
    got = S.split_oversized(df).collect()
    one = sorted((r for r in got if r.chunk_id == "1"), key=lambda r: r.piece)
    assert one[0].start_line == 11 and one[-1].end_line == 310 and len(one) == one[0].n_pieces and all(r.lines_known for r in one)
    for r in one:
        first, last = int(r.text.split()[1]), int(r.text.rstrip().rsplit("line ", 1)[1].split()[0])
        assert (r.start_line, r.end_line) == (11 + first, 11 + last) and r.token_estimate == len(r.text) // 4
    assert {r.chunk_id for r in got} == {"1", "2", "6"} and not any(r.lines_known for r in got if r.chunk_id != "1")
    assert S.split_oversized(df.where("false")).count() == 0
