"""Reading and writing of archives."""
