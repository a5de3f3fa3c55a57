"""quillspark: Spark-native curation, judging and preference analytics for scenario datasets."""
