"""handprint: distributed stylometry and authorship analysis on Spark.

Texts in, long feature tables, pair tables and scores out, expressed as
DataFrame / SQL / Spark ML jobs.
"""

from handprint.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
