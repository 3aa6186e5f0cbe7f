"""Files: CSV, XPORT, sas7bdat and XLSX members of a library, and typed CSV round trips."""
