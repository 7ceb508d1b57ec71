"""Session snapshots cut at a line."""

from skarn.operators import sessions

EVENTS = "id long, session_id long, event_type string, text string, created_at long"


def test_a_cut_behind_a_line_break_keeps_the_line_before_it(spark):
    events = spark.createDataFrame([(1, 1, "error", "aa", 1), (2, 1, "error", "bb", 2)], EVENTS)
    # 97 - 39 bytes of frame - 15 = 43: the section is cut right behind the line of aa.
    got = sessions.snapshots(events, 97).first()
    assert got.snapshot == "<session-snapshot>\n  <errors>\n    <unresolved>aa</unresolved>\n  <!-- truncated -->\n</session-snapshot>\n"
    assert got.n_bytes == len(got.snapshot)
