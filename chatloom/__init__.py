"""Conversation-data analytics on PySpark: DataFrame in, DataFrame out."""
