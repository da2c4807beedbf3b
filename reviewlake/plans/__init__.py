"""Ready-made plans: review-shaped tables over the star schema, the query catalog and the named entry points."""
