"""Views of the driver tables and the queries registered over them."""
