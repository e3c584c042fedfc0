"""The relational plan of the event table, and the registered queries."""
