"""Record intelligence on Spark: typed postings, scoring, feeds, facets, histories."""
