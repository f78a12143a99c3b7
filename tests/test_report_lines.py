from genoloom.sources import sinks


def test_shares_at_a_half(spark):
    """50 of 64 are 78.125 %, which C and the SQL write as 78.12."""
    counts = spark.createDataFrame([("3", 50), ("0", 14)], "label string, n long")
    assert [r.value[-9:] for r in sinks.report_lines(counts, "SNP QC").collect()[1:]] == ["   21.88%", "   78.12%"]
