"""Jobs to run by hand or by a scheduler: `python -m jobs.track_features --help`, `python -m jobs.turn_series --help`."""
