"""tapeloom: recorded-session analytics as Spark jobs.

Every operator takes DataFrames and returns a DataFrame; all sessions are
processed at once, keyed by ``(session_id, channel)``.
"""

__version__ = "0.1.0"
