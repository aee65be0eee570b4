"""Steps of a training-data pipeline over documents, pages and vectors.

``queries`` registers one query per operator; ``oracle`` holds the same results in SQL where
SQL can state them.
"""
