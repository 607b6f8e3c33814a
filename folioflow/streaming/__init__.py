"""The ordered folds of the operators as streaming queries."""
