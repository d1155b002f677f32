"""Archives read as streams, and words as all operators take them."""

import gzip
import io

from coderake.llm import mixing, ngram_join, token_counts, warc
from coderake.plans.tables import workspace
from tests.llm.test_operators import words
from tests.test_tables import left


def test_archives_with_large_pages_come_back_whole(spark, tmp_path):
    """A page far larger than the others, pages that look like records, many small ones, and copies of the large one."""
    large = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 400_000
    rows = [(i, f"u{i}", f"page {i % 700} " * (i % 5)) for i in range(2_000)] + [(2_000, "large", large), (2_001, "copy", large)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3, "page_id"), f"{tmp_path}/a")
    found = {r["page_id"]: r for r in warc.read_archives(spark, f"{tmp_path}/a").collect()}
    last = {text: i for i, _, text in rows}
    assert len(found) == len(rows)
    for i, url, text in rows:
        r, own = found[i], last[text] == i
        assert (r["url"], r["payload_bytes"], r["record_type"]) == (url, len(text.encode()), "response" if own else "revisit")
        assert (r["refers_to"], r["payload"]) == ((None, text) if own else (last[text], None))


def test_a_record_is_read_at_a_time():
    """The reader asks the stream for no more than a record, so a file's length does not matter."""
    class Counted(io.BytesIO):
        most = 0

        def read(self, size=-1):
            got = super().read(size)
            Counted.most = max(Counted.most, len(got) if size < 0 or size < 1 << 20 else size)
            return got

    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 1019\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" + b"x" * 1000 + b"\r\n\r\n"
    whole = Counted(gzip.compress(record * 5_000))
    seen = [(head["WARC-Type"], payload) for head, payload in warc._parsed(gzip.GzipFile(fileobj=whole))]
    assert seen == [("response", b"x" * 1000)] * 5_000
    assert Counted.most < 1 << 20


def test_words_are_those_of_the_other_operators(spark):
    """Only six ASCII characters part words: not U+001C, a no-break space or a line separator."""
    texts = ["héé ж 漢 \x1c y", "a b c", "x y\u0085z", " \t\n", "one\x0btwo\x0cthree", None]
    got = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_words"] for r in got} == {i: len(words(t)) for i, t in enumerate(texts)} == {0: 5, 1: 2, 2: 1, 3: 0, 4: 3, 5: 0}


def test_operators_leave_nothing_in_the_shared_folder_of_a_workspace(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (3, "g", None)], "doc_id long, text string, source string")
    before = left(spark)
    with workspace(spark):
        groups = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(rows).collect()}
        taken = mixing.mix(rows, mixing.cyclic_weights(rows)).count()
        assert left(spark)[0] > before[0]
    assert (groups, taken) == ({1: 1, 2: 1, 3: 3}, 3) and left(spark) == before
