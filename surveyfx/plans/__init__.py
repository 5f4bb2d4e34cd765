"""The registered queries: a survey view over the sample tables, the analyses on it, and their reference SQL."""
