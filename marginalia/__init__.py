"""Citation analytics over corpora of papers, declared as Spark plans."""
