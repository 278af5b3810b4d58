"""Job-market analytics as Spark jobs: extraction, classification, ingest, duplicate removal, search, reports."""
