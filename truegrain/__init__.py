"""truegrain: a data-quality analytics engine made of Spark plans."""
