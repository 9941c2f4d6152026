"""Reading corpora and tables, writing results and cutting lineage."""
