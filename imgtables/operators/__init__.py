"""Table operators: gates, joins, summaries, selection, clustering and comparisons."""
