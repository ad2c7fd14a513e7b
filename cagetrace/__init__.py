"""cagetrace: multi-subject position tracking analytics on Spark DataFrames.

Layout
- ``sources``   tracker logs, subject lists, fixture views, result sinks
- ``functions`` column expressions (rolling frames, null rules, t tests)
- ``operators`` cleaning, motion, pairs, contacts, measures, checks
- ``plans``     composite jobs: clean-and-derive, parameter sweep, compare, inspect
- ``streaming`` incremental sweep over a growing log folder
"""

from cagetrace.params import CleanParams, StudyDesign, SweepParams

__all__ = ["CleanParams", "StudyDesign", "SweepParams"]
