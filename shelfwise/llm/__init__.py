"""Training-data operators: one module per operator, one query ``opN_*`` each (``queries.py``)."""
