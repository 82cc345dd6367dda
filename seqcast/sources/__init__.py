"""Bar tables in, model and run tables out."""
