from lathework.sources import sinks


def test_files_are_written_in_place_one_for_each_row(spark, tmp_path):
    df = spark.createDataFrame([("a/1.txt", "x\n"), ("a/2.txt", "é"), ("b/3.txt", "")], "name string, value string")
    for _ in range(2):  # a repeated task writes the same files
        sinks.write_files(df, f"file://{tmp_path}/out")
    got = {str(p.relative_to(tmp_path / "out")): p.read_text("utf-8") for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert got == {"a/1.txt": "x\n", "a/2.txt": "é", "b/3.txt": ""}
