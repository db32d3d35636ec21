"""Vocabulary mining over large text and page corpora, written as Spark DataFrame jobs."""
