"""tracemill: behaviour analytics of tool-using agents, written as PySpark DataFrame programs."""
