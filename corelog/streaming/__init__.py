"""corelog.streaming"""
