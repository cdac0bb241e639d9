import glob

from pyspark.sql import functions as F

from folio.operators import corrections, export, pages
from folio.plans import book_export, correction
from folio.streaming import progress


def snippets(spark):
    rows = [
        ("b", 0, 0, "p", "Before."), ("b", 0, 1, "p", "It goes on and exam-"), ("b", 1, 0, "p", "ple here"), ("b", 2, 0, "note", "n"),
        ("b", 2, 1, "h1", "Title"), ("b", 2, 2, "p", "End."), ("b", 3, 0, "p", "New start."),
    ]
    return spark.createDataFrame(rows, "book_id string, page_index bigint, ord bigint, tag string, text string")


def test_join_and_chapters(spark):
    s = snippets(spark)
    joined = pages.join_apply(s, pages.join_decide(s)).orderBy("page_index", "ord").collect()
    assert [(r.page_index, r.tag, r.text) for r in joined] == [
        (0, "p", "Before."), (0, "p", "It goes on and example here"), (1, "p", ""), (2, "note", "n"), (2, "h1", "Title"), (2, "p", "End."), (3, "p", "New start.")]
    ch = export.chapters(pages.join_apply(s, pages.join_decide(s))).orderBy("chapter_no", "page_index").collect()
    assert [(r.chapter_no, r.page_index, r.title) for r in ch] == [(1, 0, "Kapitola 1"), (1, 2, "Kapitola 1"), (2, 2, "Title"), (2, 3, "Title")]


def test_files_read_in_book_order(spark, tmp_path):
    rows = [("b", i, 0, "p", f"page {i}") for i in range(200)] + [("c", 0, 0, "h2", "other")]
    s = spark.createDataFrame(rows, "book_id string, page_index bigint, ord bigint, tag string, text string").repartition(5)
    for fmt in ("txt", "md", "epub", "html"):
        plist = s.selectExpr("book_id", "page_index", "cast(page_index as string) AS page_number")
        titles = spark.createDataFrame([("b", "B")], "book_id string, title string")
        book_export.export_books(s, plist, titles, fmt, str(tmp_path / fmt))
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(str(tmp_path / "txt/book_id=b/part-*"))))
    assert [x for x in text.split("\n") if x] == [f"page {i}" for i in range(200)]
    doc = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(str(tmp_path / "html/book_id=b/part-*"))))
    assert doc.startswith("<!DOCTYPE html>") and doc.rstrip().endswith("</html>") and doc.count("<section") == 200
    assert spark.read.parquet(str(tmp_path / "epub")).count() == 201


def test_correction_round(spark):
    blocks = correction.page_documents(spark.createDataFrame(
        [(1, "<h1>T</h1><p>teh cat</p><note>n</note>"), (2, "<p>same</p>")], "page_id bigint, html string"))
    answers = spark.createDataFrame([
        (1, '{"choices":[{"message":{"content":"```json\\n{\\"changes\\":[{\\"id\\":\\"b2\\",\\"text\\":\\"the cat\\"},{\\"id\\":\\"b3\\",\\"text\\":\\"x\\"},{\\"id\\":\\"b9\\",\\"text\\":\\"new\\"}]}\\n```"}}]}'),
    ], "page_id bigint, response string")
    fixed, diff = correction.review(answers, blocks)
    rows = fixed.orderBy("page_id", "ord").collect()
    assert [(r.page_id, r.block_id, r.type, r.text) for r in rows] == [
        (1, "b1", "h1", "T"), (1, "b2", "p", "the cat"), (1, "b3", "note", "n"), (1, "b9", "p", "new"), (2, "b1", "p", "same")]
    assert {(r.block_id, r.change) for r in diff.filter("page_id = 1").collect()} == {("b1", "equal"), ("b2", "changed"), ("b3", "equal"), ("b9", "added")}


def test_request_rows(spark):
    blocks = spark.createDataFrame([(1, "b1", 0, "p", "x")], "page_id bigint, block_id string, ord bigint, type string, text string")
    settings = spark.createDataFrame([("a", "m", 0.3, 1.0, None, 10)], "name string, model string, temperature double, top_p double, reasoning_effort string, max_output_tokens bigint")
    prompts = spark.createDataFrame([("a", "a", "Fix")], "agent string, name string, prompt string")
    got = correction.prepare(blocks, settings, prompts, "a").select(F.from_json("request", "model string, instructions string, input string, temperature double").alias("r")).first().r
    assert (got.model, got.instructions, got.temperature) == ("m", "Fix", 0.3)
    assert '"blocks":[{"id":"b1","type":"p","text":"x"}]' in got.input


def test_removal_is_final(spark):
    blocks = spark.createDataFrame([(1, "b1", 0, "p", "x")], "page_id bigint, block_id string, ord bigint, type string, text string")
    changes = spark.createDataFrame([(1, 0, "b1", " "), (1, 1, "b1", "back")], "page_id bigint, ord bigint, block_id string, text string")
    assert corrections.apply_changes(blocks, changes).count() == 0


def test_progress_stream_equals_batch_and_resumes(spark, tmp_path):
    rows = [(j, f"2024-01-01 00:00:{10 * i + j:02d}", i + 1, 5, f"m{i}") for j in range(3) for i in range(5 if j else 3)]
    df = spark.createDataFrame(rows, "job_id bigint, t string, processed bigint, total bigint, message string").selectExpr(
        "job_id", "to_timestamp(t) AS ts", "processed", "total", "message")
    src, ckpt = str(tmp_path / "in"), str(tmp_path / "ckpt")
    state = {}

    def sink(batch, _):
        state.update({r.job_id: r for r in batch.collect()})

    df.filter("processed <= 2").coalesce(1).write.parquet(src)
    schema = df.schema
    progress.start_progress(spark.readStream.schema(schema).parquet(src), sink, ckpt).awaitTermination()
    assert {k: v.processed for k, v in state.items()} == {0: 2, 1: 2, 2: 2}
    df.filter("processed > 2").coalesce(1).write.mode("append").parquet(src)
    progress.start_progress(spark.readStream.schema(schema).parquet(src), sink, ckpt).awaitTermination()
    batch = {r.job_id: r for r in progress.job_progress(df).collect()}
    assert state == batch and batch[1].percent == 100.0 and batch[1].eta_seconds is None
    assert batch[0].percent == 60.0 and abs(batch[0].eta_seconds - 2 * 20 / 3) < 1e-6


def test_state_of_ended_jobs_goes_and_a_restart_loses_nothing(spark, tmp_path):
    rows = [(j, f"2024-01-01 {h:02d}:{m:02d}:00", m // 10 + 1, 3, f"m{m}") for j, h in ((1, 0), (2, 0), (1, 5), (3, 9)) for m in (0, 10, 20)] + [(9, "2024-01-02 12:00:00", 1, 1, "late clock")]
    df = spark.createDataFrame(rows, "job_id bigint, t string, processed bigint, total bigint, message string").selectExpr(
        "job_id", "to_timestamp(t) AS ts", "processed", "total", "message")
    src, ckpt, final = str(tmp_path / "in"), str(tmp_path / "ckpt"), []

    def sink(batch, _):
        final.extend((r.job_id, r.processed, r.message) for r in batch.collect())

    def run(part):
        part.coalesce(1).write.mode("append").parquet(src)
        query = progress.start_final_progress(spark.readStream.schema(df.schema).parquet(src), sink, ckpt, "30 minutes", "10 minutes")
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    run(df.filter("job_id = 2 OR (job_id = 1 AND hour(ts) = 0 AND minute(ts) < 20)"))
    assert run(df.filter("job_id = 1 AND hour(ts) = 0 AND minute(ts) = 20")) == 2 and final == []  # both still run
    left = run(df.filter("job_id = 1 AND hour(ts) = 5 OR job_id = 3"))
    assert sorted(final) == [(1, 3, "m20"), (1, 3, "m20"), (2, 3, "m20")] and left == 1  # only job 3 is left
    assert run(df.filter("job_id = 9")) == 1 and sorted(final)[-1] == (3, 3, "m20")
    batch = progress.job_progress(df, idle="30 minutes").collect()
    assert sorted(final) == sorted((r.job_id, r.processed, r.message) for r in batch if r.job_id != 9)


def test_blocks_keep_their_html_through_joins_and_exports(spark):
    rows = [
        ("b", 0, 0, "h1", "Head", '<h1 class="t">He<i>ad</i></h1>'), ("b", 0, 1, "p", "It goes on & exam-", '<p  class="x" >It <b>goes</b> on &amp; exam-</p>'),
        ("b", 1, 0, "p", "ple here.", "<p>ple <i>here</i>.</p>"), ("b", 1, 1, "note", "n", '<note style="s">n</note>'), ("b", 2, 0, "p", "Loose", ""), ("b", 2, 1, "p", "to be", "to be"), ("b", 3, 0, "p", "or not", '<p id="q">or not</p>'),
    ]
    s = spark.createDataFrame(rows, "book_id string, page_index bigint, ord bigint, tag string, text string, html string")
    joined = pages.join_apply(s, pages.join_decide(s)).orderBy("page_index", "ord")
    assert [(r.page_index, r.ord, r.html) for r in joined.collect()] == [
        (0, 0, '<h1 class="t">He<i>ad</i></h1>'), (0, 1, '<p class="x">It goes on &amp; example here.</p>'), (1, 1, '<note style="s">n</note>'),
        (2, 0, "Loose"), (2, 1, '<p id="q">to be or not</p>'), (3, 0, "")]
    [doc] = export.chapters(joined).filter("page_index = 0").collect()
    assert doc.html == '<h1 class="t">He<i>ad</i></h1>\n<p class="x">It goes on &amp; example here.</p>'
    plist = s.selectExpr("book_id", "page_index", "'' AS page_number").distinct()
    body = {r.part: r.html for r in export.to_html(joined, plist, spark.createDataFrame([("b", "B")], "book_id string, title string")).collect()}
    assert '<h1 class="t">He<i>ad</i></h1>\n<p class="x">' in body[1] and "Loose\n" in body[3]
