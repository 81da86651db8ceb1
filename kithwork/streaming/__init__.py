"""Growing tables: reply counts kept up to date by Structured Streaming."""
