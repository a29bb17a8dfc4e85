"""Domain operators: pure functions from frames and a Config to a frame. None of them collects."""
