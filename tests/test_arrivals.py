"""The streams over the given tables: one batch an arrival, whatever the number of files."""

from checks import queries


def write_documents(spark, path, files):
    rows = [(i, f"line of {i}\n" * 8, "en", "src", 80) for i in (None, *range(60))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(files).write.parquet(f"{path}/documents.parquet")


def test_batches_do_not_grow_with_the_files(spark, tmp_path):
    for files in (1, 7):
        write_documents(spark, tmp_path / str(files), files)
        stream, arrivals = queries.file_stream(spark, str(tmp_path / str(files)), (7 * 10**12 + 7, "late", "en", "late", 4))
        seen = []
        writer = stream.writeStream.foreachBatch(lambda batch, n: seen.append((n, {r.doc_id for r in batch.collect()})))
        queries.run_stream(writer.option("checkpointLocation", str(tmp_path / f"log{files}")).trigger(availableNow=True), arrivals)
        assert seen == [(0, {None, *range(0, 60, 4)}), *[(k, set(range(k, 60, 4))) for k in (1, 2, 3)], (4, {7 * 10**12 + 7})]
