"""Where panels come from: yearly files, the data dictionary, order lines."""
