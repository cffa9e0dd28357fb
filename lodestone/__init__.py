"""Analytics over technical-document corpora and parts catalogues, as Spark jobs."""
