"""quillmesh: screening, retrieval and accounting of language-model traffic as Spark DataFrame operators."""
