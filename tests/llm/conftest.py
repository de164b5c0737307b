from llm_rows import clashing, edges, nothing  # noqa: F401
