"""What several test files use."""


def one(frame, condition):
    """The only row that meets a condition, as a dict."""
    rows = frame.where(condition).collect()
    assert len(rows) == 1, rows
    return rows[0].asDict()
