"""Writers: files other tools read, published only when checks hold."""
