"""quern: document-corpus, retrieval and contract-table analytics expressed as Spark plans."""
