"""DataFrame operators: retrieval, corpus construction, audits, structure, layout, summaries."""
