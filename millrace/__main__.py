from millrace.api import main

raise SystemExit(main())
