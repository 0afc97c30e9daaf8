"""Training-data operators; their queries are in ``panelforge.llm.queries``."""
