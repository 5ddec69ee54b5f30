"""Models: native.py fits by aggregation, sequential.py holds learners that are serial by nature, grid.py runs many of them."""
