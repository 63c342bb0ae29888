"""quire: page-oriented documents as Spark tables, and what is done with them."""
