"""granthika: bilingual document retrieval, question answering and evaluation as Spark DataFrame transforms."""
