"""Training-data operators: one module an operator, registered in :mod:`pagewright.llm.queries`."""
