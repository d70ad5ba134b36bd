"""corelog.sources"""
